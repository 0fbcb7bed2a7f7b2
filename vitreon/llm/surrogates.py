"""Personal data replaced by surrogates: keyed, of the same type, gender, script and format, distinct and coreferent.

Detection finds e-mail addresses, phone, card, social security and account numbers, network addresses of both versions,
birth dates, access keys, passwords and tokens, and persons. Persons are found by what stands around them: a title, a
listed first name, a label or greeting, a verb of speech, an e-mail address of that name, or another entity right
behind. A name once found is replaced wherever it stands alone in that document. An entity's normal form (country code
and digits of a phone, lower-cased address, ...) and a secret key seed an HMAC stream, from which its surrogate draws
characters of the same class. So equal entities get equal surrogates in all documents, however they are written; no
surrogate is its own original.

Collisions are checked over the whole corpus: all distinct entities get a surrogate; where two share one, or one is
itself an entity of the corpus, all but the first try again with the next attempt, until none is left. Later attempts
draw from larger spaces, so that this ends whatever the corpus. Birth dates are permuted by a keyed cycle over all days
instead. Entities that needed a further attempt are passed on, broadcast if there are few and joined to their documents
if not. Texts are searched once: what was found travels with them through the shared folder.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from datetime import date, timedelta
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, tidy

#: Entities with a further attempt that are broadcast at most; more are joined, with the same result.
EXCEPTIONS = 20_000
#: The key of the registered query; callers pass their own secret.
KEY = b"vitreon"

# First names by script and gender (n: either), and titles with their gender.
NAMES = {
    ("latin", "f"): "Alice Anna Barbara Carmen Charlotte Clara Elena Elisabeth Emma Florence Greta Hannah Helena Ingrid Isabel Julia Karin Laura Lena Lucia Maria Marta Nina Olivia Paula Rosa Sarah Sofia Teresa Valerie".split(),
    ("latin", "m"): "Albert Anton Carlos Daniel David Diego Edward Felix Frank George Henry Hugo Ivan James Javier John Jorge Karl Louis Lucas Martin Michael Oscar Otto Pablo Paul Pierre Robert Thomas William".split(),
    ("latin", "n"): "Alex Camille Charlie Dominique Jamie Jordan Kim Morgan Robin Sasha Taylor Toni".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Ксения Людмила Мария Наталья Ольга Полина Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Дмитрий Евгений Иван Константин Максим Николай Олег Павел Сергей Фёдор Юрий".split(),
    ("cyrillic", "n"): "Саша Женя Валя Паша Слава".split(),
}
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Señor": "m",
    "Señora": "f", "Don": "m", "Doña": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "господин": "m", "госпожа": "f",
    "Dr": "n", "Prof": "n", "Doctor": "n", "Professor": "n", "доктор": "n", "профессор": "n",
}
SYLLABLES = {
    "latin": "ba be bo da de di fa fe ga go ha he ja ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve vi wa we".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де ди за зо ка ке ко ла ле ли ло ма ме ми мо на не но па пе по ра ре ри ро са се со та те то".split(),
}
#: Endings of Cyrillic surnames that tell the gender, and what a surrogate ends with.
ENDINGS = [(("ова", "ева", "ина", "ая"), "ова"), (("ов", "ев", "ин", "ий"), "ов")]
#: Country calling codes of one and two digits; all others have three.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Months by language, as they stand in dates.
MONTHS = [
    "January February March April May June July August September October November December".split(),
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split(),
]
#: Capitalised words that aren't names by themselves, lower-cased: with one of the first kind before it, what follows may still be a
#: name; an article or a word of the last kind makes it the name of something else.
_OPENERS = """yesterday today tomorrow now then when while after before although because since if but and or so as at by for from in of on to with later meanwhile however also once here there
he she it we you they i his her my our their who what where why how this that these those monday tuesday wednesday thursday friday saturday sunday
gestern heute morgen dann als nachdem während aber und oder er sie es wir ihr ich montag dienstag mittwoch donnerstag freitag samstag sonntag
hier aujourd'hui demain puis quand après mais et ou il elle nous vous ils elles je lundi mardi mercredi jeudi vendredi samedi dimanche
ayer hoy mañana luego cuando después pero y o él ella nosotros ellos ellas yo lunes martes miércoles jueves viernes sábado domingo
вчера сегодня завтра потом когда после но и или он она они мы вы я понедельник вторник среда четверг пятница суббота воскресенье
sir madam all everyone everybody team world colleagues friends president minister chairman speaker judge king queen""".split()
_ARTICLES = "the a an der die das ein eine le la les l' un une los las el una".split()
_BODIES = """times post news press journal gazette nations university college school institute academy company corporation corp inc ltd llc plc gmbh ag bank ministry department agency office bureau
council committee commission board party union association society foundation group team club court parliament senate congress government police army church museum hospital states kingdom republic federation
city county street road avenue river lake mountain island airport station hotel conference project system service services
universität hochschule gesellschaft verein ministerium amt gericht zeitung partei regierung université société ministère tribunal parti gouvernement journal universidad sociedad ministerio partido gobierno
университет компания банк министерство институт партия газета правительство""".split()
STOPS = frozenset(_OPENERS) | frozenset(_ARTICLES) | {m.lower() for some in MONTHS for m in some}
BODIES = frozenset(_BODIES)
GENDER = {n.lower(): (s, g) for (s, g), names in NAMES.items() if g != "n" for n in names}

_HINT = re.compile(r"[\d@=:]")
_MONTH = "|".join(sorted({m for some in MONTHS for m in some}, key=len, reverse=True))
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+%-])[^\W_][\w.+%-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")),
    ("secret", re.compile(r"(?i)\b(?:(?:password|passwd|pwd)\s*[=:]\s*[\"']?([^\s\"']{4,})|(?:token|secret|api[_-]?key)\s*[=:]\s*[\"']?([^\s\"']{6,}))")),
    ("key", re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b")),
    ("token", re.compile(r"(?<![\w-])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|sk-[\w-]{20,}|xox[abprs]-[\w-]{10,}|AIza[\w-]{30,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    ("mac", re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![\w:-])")),
    ("ip6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("date", re.compile(rf"(?i)\b(?:born|birth ?(?:day|date)?|date of birth|d\.?o\.?b\.?|geboren|geburtsdatum|née? le|nacid[oa]|рождения|родил(?:ся|ась))\W{{1,3}}(?:on |am |el |le )?(\d{{4}}-\d\d?-\d\d?|\d\d?([./-])\d\d?\2\d{{4}}|\d\d?\.? (?:de )?(?:{_MONTH}) (?:de )?\d{{4}}|(?:{_MONTH}) \d\d?, \d{{4}})(?!\d)")),
    ("card", re.compile(r"(?<![\d.+])\d(?:[ -]?\d){12,18}(?![\d])")),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\d+.])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}(?!\d)|(?<![\w+.,/-])0\d(?: \d\d){4}(?![\d])|(?<![\w+.,/-])0\d{2,4}[ /]\d{5,8}(?![\d])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
]
_NEEDS = {"email": "@", "ip6": ":", "key": "IA"}  # what a text must hold for a kind
_UP = r"[^\W\d_a-zа-яёß-öø-ÿ]"
_NAME = rf"{_UP}[^\W\d_]*(?:['’-][^\W\d_]+)*"
_FULL = rf"{_NAME}(?: (?:{_UP}\. )?{_NAME}){{1,2}}"
_TITLED = re.compile(rf"(?<!\w)({'|'.join(TITLES)})\.? (?:(?:Dr|Prof)\.? )?({_NAME}(?: {_NAME}){{0,2}})")
_LISTED = [n for (_, g), names in NAMES.items() if g != "n" for n in names]
_NAMED = re.compile(rf"(?<!\w)((?:{'|'.join([*_LISTED, *map(str.upper, _LISTED)])}) {_NAME})(?!\w)")
_LABELS = ["name is", "Name:", "name:", "Patient:", "Customer:", "Contact:", "Employee:", "heiße", "Name ist", "me llamo", "Me llamo", "nombre es", "Nombre:", "m'appelle", "Nom:", "Nom :", "меня зовут", "Меня зовут", "Имя:"]
_GREETINGS = ["Dear", "Hello", "Sincerely,", "Regards,", "regards,", "Signed,", "Liebe", "Lieber", "Cher", "Chère", "Estimado", "Estimada", "Уважаемый", "Уважаемая"]
_SPEECH = ["said", "says", "wrote", "writes", "called", "asked", "replied", "signed", "sagte", "schrieb", "dijo", "escribió", "a dit", "a écrit", "сказал", "сказала", "написал", "написала"]
#: What a text must hold somewhere for a pattern of names to be tried, and the pattern.
_CONTEXT = [
    (list(TITLES), _TITLED),
    ([*_LISTED, *map(str.upper, _LISTED)], _NAMED),
    (_LABELS, re.compile(rf"(?<!\w)(?:{'|'.join(_LABELS)}) *({_FULL})")),
    (_GREETINGS, re.compile(rf"(?<!\w)(?:{'|'.join(_GREETINGS)})\s+({_FULL})")),
    (_SPEECH, re.compile(rf"(?<!\w)({_FULL}),? (?:{'|'.join(_SPEECH)})(?!\w)")),
]
_BEFORE = re.compile(rf"(?<!\w)({_FULL})[\s,:;(<–-]{{1,3}}$")


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _day(found: str) -> tuple[date, str] | None:
    """A written date and its form: y, d or m first, or a month's name second (D) or first (M)."""
    n = [int(x) for x in re.findall(r"\d+", found)]
    if len(n) == 2:
        form = "D" if found[0].isdigit() else "M"
        y, m, d = n[1], _month(found)[1] + 1, n[0]
    elif n[0] > 999:
        form, (y, m, d) = "y", n
    else:
        form = "m" if n[1] > 12 or "/" in found and n[0] <= 12 else "d"
        y, m, d = n[2], n[form == "d"], n[form == "m"]
    try:
        day = date(y, m, d)
    except ValueError:
        return None
    return (day, form) if _FIRST_DAY <= day < _FIRST_DAY + timedelta(_DAYS) else None


def _month(found: str) -> tuple[str, int, int]:
    """The name of a month in a date, its number from 0, and its language."""
    name = next(w for w in re.findall(r"[^\W\d_]+", found) if w.lower() != "de")
    return next((name, [m.lower() for m in some].index(name.lower()), k) for k, some in enumerate(MONTHS) if name.lower() in (m.lower() for m in some))


def _valid(kind: str, found: str) -> bool:
    if kind == "card":
        d = _digits(found)
        return _luhn(d) == 0 and (d[0] in "3456" or "2221" <= d[:4] <= "2720")
    if kind == "iban":
        s = found.replace(" ", "")
        return 15 <= len(s) <= 34 and _iban_rest(s) == 1
    if kind == "phone":
        return 8 <= len(_digits(found)) <= 15
    if kind == "date":
        return _day(found) is not None
    if kind == "ip6":
        try:
            parts = ipaddress.IPv6Address(found).exploded.split(":")
        except ValueError:
            return False
        return any(c.isdigit() for c in found) and (sum(p != "0000" for p in parts) > 2 or found[0] in "23fF")
    return True


def _iban_end(found: str) -> int:
    """Length of the longest valid IBAN that the match begins with and that ends before a space or with it; 0 if none is.

    The pattern takes short upper-case words that follow along.
    """
    end = len(found)
    while end > 0 and not _valid("iban", found[:end]):
        end = found.rfind(" ", 0, end)
    return max(end, 0)


def normal(kind: str, found: str) -> str:
    if kind == "phone":
        d = _digits(found)
        if found.startswith("0"):  # a national form
            return f"0-{d[1:]}"
        if not found.startswith("+"):  # the pattern's other form is North American
            return f"1-{d}"
        n = next((n for n in (1, 2) if d[:n] in CALLING), 3)
        return f"{d[:n]}-{d[n:]}"
    if kind in ("card", "ssn"):
        return _digits(found)
    if kind == "email":
        return found.lower()
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "mac":
        return re.sub("[:-]", "", found).lower()
    if kind == "ip6":
        return ipaddress.IPv6Address(found).exploded
    if kind == "date":
        return _day(found)[0].isoformat()
    return found


def _script(name: str) -> str:
    return "cyrillic" if "Ѐ" <= name[0] <= "ӿ" else "latin"


def _person(text: str, a: int, b: int, gender: str = "n", least: int = 1) -> Iterator[tuple[int, int, str, str]]:
    """First names and surname of the words text[a:b]; one word alone is a surname.

    Titles in front go, and tell the gender; so do words that open sentences, and months and weekdays. Nothing is found where
    an article stands in front, a word is that of a body, or fewer than the least number of words are left.
    """
    words = [(a + m.start(), a + m.end(), m[0]) for m in re.finditer(_NAME, text[a:b])]
    words = [(i, j - 2, w[:-2]) if w[-2:] in ("'s", "’s") else (i, j, w) for i, j, w in words]
    if any(w.lower() in BODIES for _, _, w in words):
        return
    while words and (words[0][2] in TITLES or words[0][2].lower() in STOPS):
        w = words.pop(0)[2]
        if w in TITLES:
            gender, least = TITLES[w], 1
        elif w.lower() in _ARTICLES:
            return
    while len(words) > 2 and words[-1][2].lower() in STOPS:
        words.pop()
    if len(words) < least:
        return
    for k, (i, j, w) in enumerate(words):
        if k == len(words) - 1:
            yield i, j, f"last:{_script(w)}", w.lower()
        elif len(w) > 1:
            yield i, j, f"first:{_script(w)}:{gender}", w.lower()


def _one_gender(names: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The same names, with one gender for a first name throughout the document: the listed one, or what a title tells."""
    told: dict[str, str] = {}
    for _, _, kind, norm in names:
        if kind.startswith("first:") and kind[-1] != "n":
            told.setdefault(norm, kind[-1])
    gender = lambda norm: GENDER.get(norm, ("", told.get(norm, "n")))[1]
    return [(a, b, f"{kind[:-1]}{gender(norm)}" if kind.startswith("first:") else kind, norm) for a, b, kind, norm in names]


@functools.cache
def _hints():
    """An automaton over the words that the patterns of _CONTEXT need; each leads to the numbers of its patterns."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (words, _) in enumerate(_CONTEXT):
        for w in words:
            found.add_word(w, (*found.get(w, ()), k))
    found.make_automaton()
    return found


def _persons(text: str, others: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str]]:
    for k in sorted({k for _, ks in _hints().iter(text) for k in ks}):
        for m in _CONTEXT[k][1].finditer(text):
            if k > 0:
                yield from _person(text, *m.span(1), least=2)
            elif len(m[2]) > 1:
                yield from _person(text, *m.span(2), TITLES[m[1]])
    owners: set[tuple[str, str]] = set()
    for a, b, kind, norm in others:
        if kind in ("email", "phone", "card", "iban", "ssn", "date") and (m := _BEFORE.search(text, max(0, a - 80), a)):
            yield from _person(text, *m.span(1), least=2)
        if kind == "email":
            parts = [p for p in re.split(r"[\d._+%-]+", norm[: norm.rindex("@")]) if len(p) > 1 and p.isalpha()]
            if len(parts) == 2:
                owners |= {(parts[0], parts[1]), (parts[1], parts[0])}
    if owners:  # pairs of words that an address is made of, in one pass
        last = None
        for m in re.finditer(_NAME, text):
            if last and m.start() == last.end() + 1 and text[last.end()] == " " and (last[0].lower(), m[0].lower()) in owners:
                yield from _person(text, last.start(), m.end())
            last = m


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities, ascending and without overlaps; of overlapping ones the first and
    longest counts.
    """
    out: list[tuple[int, int, str, str]] = []
    if _HINT.search(text):
        for kind, pattern in PATTERNS:
            if _NEEDS.get(kind, "") not in text:
                continue
            at = 0
            while m := pattern.search(text, at):
                at = m.end()
                a, b = m.span(m.lastindex if kind == "secret" else 1 if kind == "date" else 0)
                if kind == "iban":  # what follows the valid part, or the first group if none is, may be the next one
                    n = _iban_end(m[0])
                    at, b = (a + n, a + n) if n else (a + 4, b)
                if _valid(kind, text[a:b]):
                    out.append((a, b, kind, normal(kind, text[a:b])))
    names = _one_gender(list(_persons(text, out)))
    if names:  # wherever they stand alone
        known: dict[str, tuple[str, str]] = {}
        for a, b, kind, norm in names:
            if b - a > 1 and norm not in STOPS:
                known.setdefault(norm, (kind, norm))
        taken = {e[0] for e in names}
        out += names
        for m in re.finditer(_NAME, text):
            whole = [m] if m[0].lower() in known else re.finditer(r"[^\W\d_]+", m[0])
            for w in whole:
                a = m.start() + (w.start() if w is not m else 0)
                if w[0].lower() in known and w[0][0].isupper() and a not in taken and (w[0].isupper() or not w[0][1:].isupper()):
                    out.append((a, a + len(w[0]), *known[w[0].lower()]))
    out.sort(key=lambda e: (e[0], -e[1]))
    kept, end = [], 0
    for e in out:
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


class Stream:
    """Numbers below a bound from HMAC-SHA256, keyed by kind, normal form and attempt."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{norm}\0{attempt}".encode("utf-8", "replace"), hashlib.sha256).digest()
        self.buf, self.n = b"", 0

    def below(self, n: int) -> int:
        if len(self.buf) < 4:
            self.buf += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        v, self.buf = int.from_bytes(self.buf[:4], "big"), self.buf[4:]
        return v * n >> 32

    def of(self, choice) -> str:
        return choice[self.below(len(choice))]


@functools.lru_cache(maxsize=4096)
def _peers(c: str) -> str:
    """Characters that may stand for c: of its class and its neighbourhood of code points, hence mostly its script."""
    if c.isascii():
        for some in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            if c in some:
                return some
        return "!#$%&*+-./:=?@^_~" if c.isprintable() and c != " " else c
    kind = unicodedata.category(c)
    for width in (64, 512):
        low = ord(c) // width * width
        some = "".join(x for x in map(chr, range(low, low + width)) if unicodedata.category(x) == kind)
        if len(some) > 4:
            return some
    return c


def _like(s: str, rng: Stream, signs: bool = False) -> str:
    """Each letter and digit becomes another of its class and script, with signs also every other character;
    hexadecimal stays so."""
    if len(s) >= 12 and re.fullmatch(r"(?=.*\d)(?=.*[a-f])[0-9a-f]+", s):
        return "".join(rng.of("0123456789abcdef") for _ in s)
    return "".join(rng.of(_peers(c)) if signs or c.isalnum() else c for c in s)


# Birth dates: a keyed permutation of these days.
_FIRST_DAY, _DAYS = date(1870, 1, 1), 1 << 16


def _mixed(key: bytes, n: int, back: bool = False) -> int:
    """A keyed permutation of the numbers below _DAYS: Feistel rounds on 16 bits, walked until inside."""
    while True:
        a, b = n >> 8, n & 255
        for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            if back:
                a, b = b ^ hmac.new(key, bytes([r, a]), hashlib.sha256).digest()[0], a
            else:
                a, b = b, a ^ hmac.new(key, bytes([r, b]), hashlib.sha256).digest()[0]
        n = a << 8 | b
        if n < _DAYS:
            return n


def _other_day(key: bytes, day: date) -> date:
    """The next day on a cycle through all days in a keyed order: no day is its own, no two have the same."""
    n = _mixed(key, (day - _FIRST_DAY).days, back=True)
    return _FIRST_DAY + timedelta(_mixed(key, (n + 1) % _DAYS))


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The surrogate of a normal form, itself a normal form of that kind, and never the same one.

    From attempt 8 on it grows by a character every other attempt (names: by a syllable every fourth attempt; addresses of
    version 4 turn into version 6 from attempt 64 on), so there is always room.
    """
    if kind == "date":
        return _other_day(key, date.fromisoformat(norm)).isoformat()
    rng = Stream(key, kind, norm, attempt)
    new = norm
    tries = 0
    while new == norm:
        more = max(0, attempt - 6) // 2 + tries // 32
        new = _drawn(kind, norm, rng, attempt, more)
        tries += 1
    return new


def _drawn(kind: str, norm: str, rng: Stream, attempt: int, more: int) -> str:
    extra = lambda some: "".join(rng.of(some) for _ in range(more))
    if kind == "email":
        at, dot = norm.rindex("@"), norm.rindex(".")
        return _like(norm[:at], rng) + extra("abcdefghijklmnopqrstuvwxyz") + "@" + _like(norm[at + 1 : dot], rng) + norm[dot:]
    if kind == "key":
        return norm[:4] + "".join(rng.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in norm[4:]) + extra("ABCDEFGH")
    if kind == "token":
        n = re.match(r"[a-z]+_(?:pat_)?|sk-|xox\w-|AIza|eyJ", norm).end()
        return norm[:n] + _like(norm[n:], rng) + extra("abcdefghijklmnopqrstuvwxyz")
    if kind == "mac":
        # the first octet says whether an address is a single one's and a maker's
        return norm[:2] + "".join(rng.of("0123456789abcdef") for _ in norm[2:]) + "".join(rng.of("0123456789abcdef") for _ in range(2 * more))
    if kind == "ip":
        if attempt >= 64:
            return _drawn("ip6", "2001:0db8:1111:1111:1111:1111:1111:1111", rng, attempt, 0)
        parts = []
        for p in norm.split("."):
            # short octets are few: after many attempts any octet will do
            lo, hi = {1: (0, 9), 2: (10, 99), 3: (100, 255)}[len(p)] if attempt < 16 else (0, 255)
            parts.append(str(lo + rng.below(hi - lo + 1)))
        return ".".join(parts)
    if kind == "ip6":
        parts = [f"{int(p, 16):x}" if int(p, 16) or more else "" for p in norm.split(":")]  # zeros stay, until there is no other room
        new = [(p[0] if k == 0 else rng.of("123456789abcdef")) + "".join(rng.of("0123456789abcdef") for _ in p[1:]) if p else "0" for k, p in enumerate(parts)]
        return ":".join(p.zfill(4) for p in new)
    if kind == "card":
        s = norm[0] + _like(norm[1:], rng) + extra("0123456789")
        return s[:-1] + str(-_luhn(s[:-1] + "0") % 10)
    if kind == "iban":
        s = norm[:2] + "00" + _like(norm[4:], rng) + extra("0123456789")
        return f"{s[:2]}{98 - _iban_rest(s):02d}{s[4:]}"
    if kind == "phone":
        n = norm.index("-") + 1
        return norm[:n] + _like(norm[n:], rng) + extra("0123456789")
    if kind.startswith("first:"):
        _, script, gender = kind.split(":")
        # attempts beyond the list's length add a syllable, so distinct names never run out
        return rng.of(NAMES[script, gender]).lower() + "".join(rng.of(SYLLABLES[script]) for _ in range(attempt // 4))
    if kind.startswith("last:"):
        script = kind.split(":")[1]
        end = next((e for tails, e in ENDINGS if norm.endswith(tails)), "") if script == "cyrillic" else ""
        return "".join(rng.of(SYLLABLES[script]) for _ in range(3 + attempt // 4)) + end
    # what holds few letters and digits is drawn anew with its signs
    signs = sum(len(_peers(c)) > 1 for c in norm if c.isalnum()) < 6
    return _like(norm, rng, signs) + extra("abcdefghijklmnopqrstuvwxyz" if kind == "secret" else "0123456789")


def rendered(kind: str, found: str, norm: str, new: str) -> str:
    """The surrogate in the form in which the entity was written."""
    if kind in ("phone", "card", "ssn", "iban"):
        src = new if kind != "phone" else new.replace("-", "", 1) if found[0] in "+0" else new[new.index("-") + 1 :]
        at = iter(src)
        return "".join(next(at, "") if c.isalnum() else c for c in found) + "".join(at)
    if kind == "email":
        return new.upper() if found.isupper() else new
    if kind == "mac":
        out = found[2].join(new[i : i + 2] for i in range(0, len(new), 2))
        return out.upper() if found.isupper() else out
    if kind == "ip6":
        short = new if len(found) == 39 else str(ipaddress.IPv6Address(new))
        return short.upper() if found.isupper() else short
    if kind == "date":
        day, form = date.fromisoformat(new), _day(found)[1]
        if form in "DM":
            name, _, language = _month(found)
            month = MONTHS[language][day.month - 1]
            numbers = iter((str(day.day), str(day.year)))
            return re.sub(r"\d+", lambda _: next(numbers), found.replace(name, month.upper() if name.isupper() else month.capitalize() if name[0].isupper() else month.lower(), 1))
        at = iter({"y": (day.year, day.month, day.day), "d": (day.day, day.month, day.year), "m": (day.month, day.day, day.year)}[form])
        return re.sub(r"\d+", lambda m: f"{next(at):0{len(m[0]) if m[0][0] == '0' or len(m[0]) > 2 else 1}d}", found)
    if kind.startswith(("first:", "last:")):
        return new.upper() if found.isupper() and len(found) > 1 else new.capitalize()
    return new


def rewrite(text: str, found: list, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    out, at, kinds = [], 0, []
    for a, b, kind, norm in found:
        out += [text[at:a], rendered(kind, text[a:b], norm, surrogate(key, kind, norm, attempts.get((kind, norm), 0)))]
        at = b
        kinds.append(kind.split(":")[0])
    return "".join([*out, text[at:]]), kinds


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    return rewrite(text, find(text), key, attempts)


_SPAN = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("norm", pa.string())])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, text (valid UTF-8) and found, the entities' places in code points, kinds and normal forms."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [None if t is None else t.decode("utf-8", "replace") for t in b.column(1).to_pylist()]
            found = [[{"a": x, "b": y, "kind": k, "norm": n} for x, y, k, n in find(t)] if t else [] for t in text]
            yield pa.record_batch([b.column(0), pa.array(text, pa.string()), pa.array(found, pa.list_(_SPAN))], ["doc_id", "text", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return raw.mapInArrow(run, f"doc_id {kind}, text string, found array<struct<a:int,b:int,kind:string,norm:string>>")


def _tried(ents: DataFrame, key: bytes) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, k, n, a) for k, n, a in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.record_batch([*b.columns, pa.array(new, pa.string())], ["kind", "norm", "attempt", "new"])

    return ents.select("kind", "norm", "attempt").mapInArrow(run, "kind string, norm string, attempt int, new string")


def settle(ents: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, norm, attempt) of the entities whose attempt isn't 0, after which no two surrogates of a kind agree and
    none is an entity of the corpus (first names, drawn from a short list of real ones, and birth dates, permuted among
    all days, may be another's).
    """
    all_ = scratch.keep(_tried(ents.withColumn("attempt", F.lit(0)), key), "tried")
    real = ents.select("kind", F.col("norm").alias("new")).where("kind not like 'first:%' and kind <> 'date'")
    for turn in count(1):
        best = all_.groupBy("kind", "new").agg(F.min(F.struct("attempt", "norm")).alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
        lost = all_.join(best, ["kind", "new"]).where(F.struct("attempt", "norm") != F.col("best")).select("kind", "norm")
        # only those tried last can meet an entity; the others were checked before
        met = all_.where(F.col("attempt") == turn - 1).join(real, ["kind", "new"], "left_semi").select("kind", "norm")
        again = scratch.keep(lost.union(met).distinct(), "again")
        if again.isEmpty():
            scratch.drop(again)
            break
        rest = all_.join(again, ["kind", "norm"], "left_anti")
        more = _tried(again.withColumn("attempt", F.lit(turn)), key)
        old, all_ = all_, scratch.keep(rest.unionByName(more), "tried")
        scratch.drop(old, again)
    odd = scratch.keep(all_.where("attempt > 0").select("kind", "norm", "attempt"), "odd")
    scratch.drop(all_)
    return odd


def _rewritten(rows: DataFrame, key: bytes, shared: dict) -> DataFrame:
    """rows: doc_id, text, found, own (attempts of entities of this row; null: those of shared)."""
    common = rows.sparkSession.sparkContext.broadcast(shared)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempts = common.value
        for b in batches:
            new, kinds = [], []
            for t, f, o in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not f:
                    new.append(t.as_py())
                    kinds.append([])
                    continue
                here = {(x["kind"], x["norm"]): x["attempt"] for x in o} if o else attempts
                text, k = rewrite(t.as_py(), [tuple(x.values()) for x in f], key, here)
                new.append(text)
                kinds.append(k)
            yield pa.record_batch([b.column(0), pa.array([len(k) for k in kinds], pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(new, pa.string())], ["doc_id", "n_entities", "kinds", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "found", "own").mapInArrow(run, f"doc_id {kind}, n_entities bigint, kinds array<string>, text string")


def mask(docs: DataFrame, key: bytes, exceptions: int = EXCEPTIONS) -> DataFrame:
    """doc_id, n_entities, kinds (in order), text with surrogates.

    A null text stays null with no entities; a text without entities is returned as it is. Rows pass one by one, repeated
    or not, a null doc_id included; other columns are ignored; an empty table gives an empty one. Secrets may consist of
    any characters: what has few letters and digits is drawn anew as a whole.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")
    rows = scratch.keep(detect(docs).withColumn("row", F.monotonically_increasing_id()), "found")
    spans = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.kind", "f.norm")
    ents = scratch.keep(spans.select("kind", "norm").distinct(), "entities")
    odd = settle(ents, key, scratch)
    scratch.drop(ents)
    few = odd.limit(exceptions + 1).collect()
    attempt = "array<struct<kind:string,norm:string,attempt:int>>"
    if len(few) <= exceptions:
        scratch.drop(odd)
        return _rewritten(rows.withColumn("own", F.lit(None).cast(attempt)), key, {(r["kind"], r["norm"]): r["attempt"] for r in few})
    own = spans.distinct().join(odd, ["kind", "norm"]).groupBy("row").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("own"))
    own = scratch.keep(own.withColumnRenamed("row", "_row"), "own")
    scratch.drop(odd)
    return _rewritten(rows.join(own.hint("merge"), F.col("row") == F.col("_row"), "left"), key, {})


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mask(docs, KEY)
