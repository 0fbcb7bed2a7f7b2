"""Plain versions of the operators for small inputs; nothing here is shared with them."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= k:
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def ngram_join(rows, k, percent):
    """[(doc_id, n_shingles, component_id)]"""
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t)]
    comp = components({i for i, _ in sets if i is not None}, links)
    return [(i, len(s), comp.get(i)) for i, s in sets]


def ngram_links(rows, k, percent):
    """[(doc_id, n_shingles, component_id, class_id, n_links)]"""
    sets = [(i, shingles(t, k)) for i, t in rows]
    out = []
    for (i, s), (_, n, comp) in zip(sets, ngram_join(rows, k, percent), strict=True):
        near = {j for j, t in sets if j is not None and s and t and 100 * len(s & t) >= percent * len(s | t)}
        alike = min((j for j, t in sets if j is not None and s and t == s), default=i)
        out.append((i, n, comp, alike, len(near - {i})) if i is not None else (None, n, None, None, None))
    return out


def line_chunks(text, cut=3):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    start = 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (h[i] + (31 * h[i - 1] if i else 0)) % cut == 0:
            yield start, lines[start : i + 1]
            start = i + 1


def line_dedup(rows):
    """[(doc_id, n_lines, n_removed, text)]"""
    order = sorted({(i is not None, i or 0, hashlib.md5(t.encode()).hexdigest(), t) for i, t in rows if t is not None})
    seen, made = set(), {}
    for known, i, dig, t in order:
        kept, gone = [], 0
        for _, chunk in line_chunks(t):
            key = "\n".join(chunk)
            if len(chunk) >= 2 and key in seen:
                gone += len(chunk)
                continue
            if len(chunk) >= 2:
                seen.add(key)
            kept += chunk
        made[(i if known else None), t] = (len(t.split("\n")), gone, "\n".join(kept))
    return [(i, 0, 0, None) if t is None else (i, *made[i, t]) for i, t in rows]


def line_passages(rows, least=2):
    """[(doc_id, n_lines, n_removed, text)]"""
    order = sorted({(i is not None, i or 0, hashlib.md5(t.encode()).hexdigest(), t) for i, t in rows if t is not None})
    runs = {d: ["\n".join(d[3].split("\n")[s : s + least]) for s in range(len(d[3].split("\n")) - least + 1)] for d in order}
    times, first = Counter(x for d in order for x in runs[d]), {}
    made = {}
    for d in order:
        lines, gone, stay = d[3].split("\n"), set(), set()
        for s, x in enumerate(runs[d]):
            if times[x] > 1:
                (stay if first.setdefault(x, (d, s)) == (d, s) else gone).update(range(s, s + least))
        gone -= stay
        made[(d[1] if d[0] else None), d[3]] = (len(lines), len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone))
    return [(i, 0, 0, None) if t is None else (i, *made[i, t]) for i, t in rows]


def suffix_dedup(rows, length=200):
    """[(doc_id, n_bytes, n_removed, n_spans, sha of what is left)]"""
    raw = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if times[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def mixing_targets(sizes, share=1.5, weights=(3, 1, 2)):
    """{source: target}: proportional, full sources cut at twice their size, the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = [s for s in open_ if t[s] >= 2 * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: 2.0 * sizes[s] for s in over}


def tilt(sizes, target):
    """l of the rates min(2, exp(l * size / mean)) whose words meet the target, by bisection."""
    mean = max(1.0, sum(sizes) / len(sizes))
    if target >= 2 * sum(sizes) * (1 - 1e-12):
        return math.inf, mean
    low, high = -1e4, 1e4
    for _ in range(200):
        l = (low + high) / 2
        got = sum(s * min(2.0, math.exp(min(50.0, l * s / mean))) for s in sizes)
        low, high = (l, high) if got < target else (low, l)
    return (low + high) / 2, mean


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lexical(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] of rows (doc_id, text) and (item_id, text)"""
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms, df = len(found), sum(sum(c.values()) for _, c in found), Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in found:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms
            one = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if one > 0:
                scored.append((-one, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


def _digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*fields):
    return _digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _tree(nodes):
    """The levels from the bottom up to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def manifest(rows):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)] of rows (doc_id, source, lang, n_chars, text)"""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(*r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(langs[g], key=lambda x: x[:3])]) for g in order}
    top = _tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for pos, (_, _, leaf, r) in enumerate(sorted(langs[g], key=lambda x: x[:3])):
            steps = []
            for p, levels in ((pos, trees[g]), (at, top)):
                for level in levels[:-1]:
                    steps.append((p % 2, level[p ^ 1] if p ^ 1 < len(level) else ""))
                    p //= 2
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = _leaf(r[0], r[1], r[2], r[3] + 1 if odd and r[3] is not None else r[3], r[4])
            for right, s in steps:
                h = _digest(s, h) if right else _digest(h, s)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], _digest(*(s for _, s in steps)), h, h == top[-1][0]))
    return out
