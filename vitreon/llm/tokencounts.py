"""Token counts of a byte-level BPE tokenizer file, with a shortcut for pre-tokens that are one token.

Before any text is read, every string of the vocabulary goes through the merges: those that end as one token are proven
to be one wherever they stand as a pre-token, since merges never cross pre-tokens. The driver proves them once and
sends the list along; its size is the vocabulary's. A text's pre-tokens are looked up in that list and counted; only the
rest is merged, each distinct word of a slice once. Nothing is shuffled, and the words kept are bounded, so memory
doesn't grow with the corpus; a lost executor repeats its own slices only.

The characters that count as letters, digits and blanks are those of the library whose counts are to be met: it is asked
once for all code points, since its edition of Unicode may differ from that of the regex module.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import NONE, SLICE, WORDS_AT_ONCE, WORDS_KEPT, Codec
from .common import spans, texts, tidy

LIMIT = 1024
#: The pattern of byte-level pre-tokens, over classes of characters: letters, digits, blanks.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{L}{N}]+|{S}+(?![^{S}])|{S}+"


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others
    follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def classes(split) -> dict[str, list[tuple[int, int]]]:
    """Ranges of the code points that a splitter takes for letters (L), digits (N) and blanks (S).

    split: function of a text, giving the (start, end) of its pre-tokens. All code points from 128 on, one after another,
    fall into runs of one class; each run's first character, and each of ASCII, is then tried behind a letter, a digit and a sign.
    """

    def kind_of(c: str) -> str:
        return next((k for k, mate in (("L", "a"), ("N", "1"), ("", "!")) if len(split(mate + c)) == 1), "S")

    points = [*range(0x80, 0xD800), *range(0xE000, 0x110000)]
    out: dict[str, list[tuple[int, int]]] = {"L": [], "N": [], "S": []}
    for p in range(0x80):
        if kind := kind_of(chr(p)):
            out[kind].append((p, p))
    for a, b in split("".join(map(chr, points))):
        if kind := kind_of(chr(points[a])):
            out[kind] += [(points[a], points[b - 1])] if (points[a] < 0xD800) == (points[b - 1] < 0xD800) else [(points[a], 0xD7FF), (0xE000, points[b - 1])]
    return out


def pattern_of(found: dict[str, list[tuple[int, int]]]) -> str:
    """The pattern with these classes spelt out."""
    sets = {k: "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in v) for k, v in found.items()}
    out = _PATTERN
    for k, v in sets.items():
        out = out.replace(f"[^{{{k}}}]", f"[^{v}]").replace(f"{{{k}}}+", f"[{v}]+").replace(f"{{{k}}}", v)
    return out


def differing(found: dict[str, list[tuple[int, int]]]) -> str | None:
    """A set of the code points that the regex module puts in another class, or None."""
    import regex

    kinds = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}"), "S": regex.compile(r"\s")}
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    odd: set[int] = set()
    for k, one in kinds.items():
        there = np.zeros(0x110000, bool)
        for a, b in found[k]:
            there[a : b + 1] = True
        here = np.zeros(0x110000, bool)
        here[[ord(c) for c in one.findall(points)]] = True
        odd.update(np.flatnonzero(here != there).tolist())
    if not odd:
        return None
    cuts = sorted(odd)
    ranges, lo = [], cuts[0]
    for x, y in zip(cuts, [*cuts[1:], -1], strict=True):
        if y != x + 1:
            ranges.append((lo, x))
            lo = y
    return "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges) + "]"


def prepare(file: bytes) -> dict:
    """What workers need of a tokenizer file: merges in rank order, added tokens, pre-tokens proven to be one token, and the pattern.

    Refuses (ValueError) files whose features aren't covered: other models than BPE, normalizers, other pre-tokenizers than
    byte-level ones with their pattern, affixes of words, added tokens bound to words or blanks, and strings that two merges make.
    """
    from tokenizers import Tokenizer

    spec = json.loads(file)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "unk_token") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or odd or spec["normalizer"]:
        raise ValueError(f"not a plain BPE model: {model.get('type')} {odd} {spec['normalizer']}")
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"not a byte-level pre-tokenizer with its pattern: {pre}")
    added = [t for t in spec["added_tokens"] if t["content"]]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens bound to words or blanks")
    letters = byte_letters()
    as_bytes = lambda s: bytes(letters[c] for c in s)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made = [as_bytes(a) + as_bytes(b) for a, b in merges]
    if len(set(made)) < len(made):
        raise ValueError("a string that two merges make")
    number = {bytes([i]): i for i in range(256)} | {m: 256 + i for i, m in enumerate(made)}
    split = Tokenizer.from_str(file.decode()).pre_tokenizer.pre_tokenize_str
    found = classes(lambda s: [at for _, at in split(s)])
    out = {
        "pairs": np.array([(number[as_bytes(a)], number[as_bytes(b)]) for a, b in merges], np.int64).reshape(-1, 2),
        # tokens outside normalized text are cut out first
        "added": [[t["content"] for t in added if t["normalized"] == n] for n in (False, True)],
        "pattern": pattern_of(found),
        "odd": differing(found),
    }
    vocabulary = [s for s in model["vocab"] if all(c in letters for c in s)]
    raw = [as_bytes(s) for s in vocabulary]
    if model.get("ignore_merges"):
        alone = raw
    else:
        size = Merges(out | {"alone": []}).replay(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64))[1]
        alone = [r for r, n in zip(raw, size.tolist(), strict=True) if n == 1]
    proven = set(alone)
    out["alone"] = [s for s in (r.decode("utf-8", "ignore") for r in alone) if s.encode() in proven]  # the others are parts of characters
    return out


class Merges(Codec):
    """Merges by rank, numbered from 256 on, and the sizes of the words met so far."""

    def __init__(self, ready: dict, words_kept: int = WORDS_KEPT):
        import regex

        self.single = np.arange(256, dtype=np.int32)
        keys = ready["pairs"][:, 0] << 24 | ready["pairs"][:, 1]
        rank = 256 + np.arange(len(keys), dtype=np.int32)
        self.pairs = dict(zip(keys.tolist(), rank.tolist(), strict=True))
        order = np.argsort(keys)
        self.keys, self.made = (keys[order], rank[order]) if len(keys) else (np.array([-1], np.int64), np.array([NONE], np.int32))
        either = lambda some: regex.compile("|".join(map(regex.escape, sorted(some, key=len, reverse=True)))) if some else None
        self.added = [p for p in map(either, ready["added"]) if p]
        from_regex = _PATTERN.replace("[^{S}{L}{N}]", r"[^\s\p{L}\p{N}]").replace("[^{S}]", r"\S").replace("{S}", r"\s").replace("{L}", r"\p{L}").replace("{N}", r"\p{N}")
        self.plain, self.exact = regex.compile(from_regex), regex.compile(ready["pattern"])
        self.odd = regex.compile(ready["odd"]) if ready["odd"] else None
        self.alone = frozenset(ready["alone"])
        self.words_kept = words_kept
        self.forget()

    def forget(self) -> None:
        self.size: dict[str, int] = {}

    def pieces(self, text: str) -> Iterator[str | None]:
        """The text between added tokens, and None for each of these."""
        parts: list[str | None] = [text]
        for p in self.added:
            cut: list[str | None] = []
            for s in parts:
                if s is None or not p.search(s):
                    cut.append(s)
                    continue
                at = 0
                for m in p.finditer(s):
                    cut += [s[at : m.start()], None]
                    at = m.end()
                cut.append(s[at:])
            parts = cut
        yield from parts

    def words(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a piece of text, some at a time."""
        find = self.exact if self.odd is not None and not text.isascii() and self.odd.search(text) else self.plain
        if len(text) < 1_000_000:
            yield find.findall(text)
        else:
            all_ = (m[0] for m in find.finditer(text))
            while some := list(islice(all_, WORDS_AT_ONCE)):
                yield some

    def learn(self, words: set[str]) -> None:
        """Merge these words together and note how many tokens each of them is."""
        some = list(words)
        raw = [w.encode("utf-8", "replace") for w in some]
        n = self.replay(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64))[1]
        self.size.update(zip(some, n.tolist(), strict=True))

    def count_batch(self, batch: list[str]) -> tuple[list[int], list[int]]:
        """Tokens of each text, and how many of them are pre-tokens counted without merging."""
        if len(self.size) > self.words_kept:
            self.forget()
        direct, rest, fixed = [], [], []
        alone = self.alone
        for text in batch:
            here, others, added = 0, Counter(), 0
            for piece in self.pieces(text):
                if piece is None:
                    added += 1
                    continue
                for words in self.words(piece):
                    more = [w for w in words if w not in alone]
                    here += len(words) - len(more)
                    others.update(more)
            direct.append(here)
            rest.append(others)
            fixed.append(added)
        new = {w for others in rest for w in others if w not in self.size}
        if new:
            self.learn(new)
        size = self.size
        return [d + f + sum(n * size[w] for w, n in o.items()) for d, o, f in zip(direct, rest, fixed, strict=True)], direct


_ready: dict[int, Merges] = {}


def _merges(shared) -> Merges:
    if shared.id not in _ready:
        _ready.clear()
        _ready[shared.id] = Merges(shared.value)
    return _ready[shared.id]


class _Shared:
    """A broadcast value and a name for it that a worker can keep it by."""

    def __init__(self, spark: SparkSession, value: dict):
        self.sent = spark.sparkContext.broadcast(value)
        self.id = hash((value["pairs"].tobytes(), tuple(map(tuple, value["added"])), value["pattern"]))

    @property
    def value(self) -> dict:
        return self.sent.value


def count(docs: DataFrame, file: bytes, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than limit) and n_direct (pre-tokens that were counted
    without merging) of every row.

    file: content of a tokenizer file of the tokenizers library; tokens are those that it gives without template tokens,
    while its added tokens count as one each where their strings stand in a text, as is its default. A null or empty
    text has no bytes and no tokens; rows pass one by one, repeated or not, a null doc_id included; other columns are
    ignored; an empty table gives an empty one. A very long text is cut into words some at a time.
    """
    shared = _Shared(docs.sparkSession, prepare(file))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(shared)
        for b in batches:
            off = texts(b)[1]
            for start, stop in spans(off, SLICE):
                n, direct = merges.count_batch([(t.as_py() or b"").decode("utf-8", "replace") for t in b.column(1).slice(start, stop - start)])
                size = np.diff(off[start : stop + 1])
                yield pa.record_batch(
                    [b.column(0).slice(start, stop - start), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(direct, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_direct"],
                )
        merges.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_direct bigint")


def tokenizer(name: str = "byte_bpe_50k.json") -> bytes:
    """A public tokenizer file."""
    import public_tokenizers as P

    with open(P.path(name), "rb") as f:
        return f.read()


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return count(docs, tokenizer())
