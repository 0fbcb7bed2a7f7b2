"""Document fingerprints from prefix polynomial hashes.

A slice of documents becomes one array of code points with modular prefix sums for two primes below 2**31. Any
span's hash is then two subtractions and multiplications, so equality of any two spans is a comparison, and the
longest common extension of two positions a binary search over lengths. A fingerprint holds the text's length, its
whole-span hash and the SKETCH smallest hashes of its spans of SPAN code points (and of its shorter beginnings), a
span that stands again counting anew; the likeness of two fingerprints is the Dice coefficient (the share in common) that their sketches estimate.

An edited text's hashes are not computed anew: its windows are windows of the text, windows of the next document,
and SPAN - 1 that straddle the seam, whose hashes are sums of the two parts' shifted span hashes.

Documents are dealt by ranges of doc_id once; every range's first document visits the range before as a guest, so
no task sees more than its range and the last document meets the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, parts, spans, texts, tidy

SPAN = 10
SKETCH = 64
#: Primes and bases of the two polynomial hashes (fixed values).
MODULI = ((2147483647, 1000003), (2147483629, 999983))
#: Bytes of text whose prefix arrays exist at once.
SLICE = 1 << 20
_POWERS: dict[tuple[int, int], np.ndarray] = {}
_KEEP = 1 << 21


def powers(p: int, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo p, by doubling."""
    have = _POWERS.get((p, base), np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), p)) % np.uint64(p)])
    if len(have) <= _KEEP:
        _POWERS[p, base] = have
    return have[:n]


class Prefixes:
    """Prefix arrays of an array of code points; spans are half-open."""

    def __init__(self, points: np.ndarray, moduli: tuple = MODULI):
        self.n = len(points)
        c = points.astype(np.uint64) + np.uint64(1)
        self.parts = []
        for p, base in moduli:
            m = np.uint64(p)
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * powers(p, base, self.n) % m, out=s[1:])  # fewer than 2**33 terms below 2**31
            self.parts.append((m, s % m, powers(p, base, self.n + 1), powers(p, pow(base, -1, p), self.n + 1)))

    def values(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Each modulus' hash of the spans, independent of where they stand."""
        return [(s[end] + m - s[start]) % m * inv[start] % m for m, s, _, inv in self.parts]

    def join(self, left: list[np.ndarray], length: np.ndarray, right: list[np.ndarray]) -> list[np.ndarray]:
        """The hash of a span of this length followed by another."""
        return [(a + up[length] * b) % m for (m, _, up, _), a, b in zip(self.parts, left, right, strict=True)]

    @staticmethod
    def key(values: list[np.ndarray]) -> np.ndarray:
        return mix(values[0] << np.uint64(31) | values[1])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for x, y in zip(self.values(a, a + length), self.values(b, b + length), strict=True):
            out &= x == y
        return out

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension of the positions a and b, up to most, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def smallest(h: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """The k smallest values of a multiset of hashes, ascending, as 32-bit numbers: each further occurrence of a hash
    counts as a value of its own."""
    h = np.sort(h)
    first = np.append(True, h[1:] != h[:-1])[: len(h)]
    at = np.flatnonzero(first)
    place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    with np.errstate(over="ignore"):
        v = (mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    if len(v) > 2 * k:
        v = np.partition(v, 2 * k)[: 2 * k]
    return np.unique(v)[:k]


def spell(n: int, whole: int, sketch: np.ndarray) -> str:
    return f"{n:x}-{whole:016x}-{sketch.astype('>u4').tobytes().hex()}"


def sketch_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint.rpartition("-")[2]), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, same: bool = False, k: int = SKETCH) -> float:
    """Dice coefficient of the span sets behind two sketches, 0 to 1; the same fingerprint has 1."""
    if same:
        return 1.0
    both = np.concatenate([a, b])
    if not len(both):
        return 0.0
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    fresh = np.ones(len(both), bool)
    fresh[1:] = both[1:] != both[:-1]
    union = both[fresh][:k]
    j = np.searchsorted(twice, union[-1], "right") / len(union)
    return float(2 * j / (1 + j))


def decoded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (made valid UTF-8 if they weren't), code points, each point's first byte, rows' offsets in points."""
    raw = data.tobytes()
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        rows = [raw[i:j].decode("utf-8", "replace").encode() for i, j in zip(off[:-1], off[1:], strict=True)]
        off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        raw = b"".join(rows)
        data, text = np.frombuffer(raw, np.uint8), raw.decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    return data, points, np.append(lead, len(data)), np.searchsorted(lead, off)


def beginnings(pre: Prefixes, a: np.ndarray, keep: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Hashes of the beginnings of 1 to SPAN - 1 code points of texts of n that consist of keep ones from a on and others
    from b on. With them a text has as many spans as code points, however short it is.
    """
    j = np.arange(1, SPAN)[None, :]
    own = np.minimum(j, keep[:, None])
    more = np.where(j <= n[:, None], j - own, 0)
    start, other = np.broadcast_to(a[:, None], own.shape), np.broadcast_to(b[:, None], own.shape)
    key = Prefixes.key(pre.join(pre.values(start, start + own), own, pre.values(other, other + more)))
    with np.errstate(over="ignore"):
        key = mix(key + j.astype(np.uint64))
    return [k[: min(SPAN - 1, m)] for k, m in zip(key, n.tolist(), strict=True)]


def prints(data: np.ndarray, off: np.ndarray, emit: np.ndarray) -> tuple:
    """Fingerprints of rows and of their edited texts; row i's next document is row i + 1, and emit says which
    rows have one. Returns lists over the emitted rows.
    """
    data, points, lead, at = decoded(data, off)
    pre = Prefixes(points)
    n = np.diff(at)
    k = n // 4
    total = len(points)
    i = np.arange(max(0, total - SPAN + 1))
    h = Prefixes.key(pre.values(i, i + SPAN)) if len(i) else np.zeros(0, np.uint64)
    whole = Prefixes.key(pre.values(at[:-1], at[1:]))
    begin = beginnings(pre, at[:-1], n, at[:-1], n)
    sketch = [smallest(np.concatenate([g, h[a : max(a, b - SPAN + 1)]])) for g, a, b in zip(begin, at[:-1].tolist(), at[1:].tolist(), strict=True)]
    text = [spell(int(n[r]), int(whole[r]), sketch[r]) for r in range(len(n))]
    rows = np.flatnonzero(emit)
    if not len(rows):
        return (), (), (), (), (), (), (), ()
    nxt = rows + 1
    keep = n[rows] - k[rows]
    take = np.minimum(k[rows], n[nxt])
    a0, b0 = at[rows], at[nxt]
    whole2 = Prefixes.key(pre.join(pre.values(a0, a0 + keep), keep, pre.values(b0, b0 + take)))
    common = keep + pre.extension(a0 + keep, b0, take)
    begin = beginnings(pre, a0, keep, b0, keep + take)
    edited, sha, near_edited, near_next = [], [], [], []
    raw = data.tobytes()
    for r, x, kp, tk, a, b, w, g in zip(rows.tolist(), nxt.tolist(), keep.tolist(), take.tolist(), a0.tolist(), b0.tolist(), whole2, begin, strict=True):
        left = np.arange(max(0, kp - SPAN + 1), min(kp, kp + tk - SPAN + 1))
        found = [g, h[a : a + max(0, kp - SPAN + 1)], h[b : b + max(0, tk - SPAN + 1)]]
        if len(left):
            size = kp - left
            found.append(Prefixes.key(pre.join(pre.values(a + left, np.full(len(left), a + kp)), size, pre.values(np.full(len(left), b), b + SPAN - size))))
        s = smallest(np.concatenate(found))
        e = spell(kp + tk, int(w), s)
        edited.append(e)
        sha.append(hashlib.sha256(raw[lead[a] : lead[a + kp]] + raw[lead[b] : lead[b + tk]]).hexdigest())
        near_edited.append(likeness(sketch[r], s, e == text[r]))
        near_next.append(likeness(sketch[r], sketch[x], text[r] == text[x]))
    return rows, n[rows], sha, [text[r] for r in rows], edited, near_edited, near_next, common


def ring(docs: DataFrame, per_task: int = 8) -> DataFrame:
    """doc_id, text and the range `_to`, `_guest`: sorted so that within a range each row's successor follows it."""
    spark = docs.sparkSession
    from pyspark.ml.feature import Bucketizer

    base = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("_key"))
    n = parts(spark) * per_task
    cuts = docs.where("doc_id is not null").select(F.col("doc_id").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) == 2:
        splits = [float("-inf"), 0.0, float("inf")]
    base = Bucketizer(splits=splits, inputCol="_key", outputCol="_range").transform(base)
    # one row a range: at most per_task times the number of partitions
    firsts = Bucketizer(splits=splits, inputCol="_key", outputCol="_range").transform(base.select("doc_id", "_key")).groupBy("_range").agg(F.min("_key").alias("first")).orderBy("_range").collect()
    goes = [(float(r["_range"]), float(r["first"]), float(firsts[i - 1]["_range"])) for i, r in enumerate(firsts)]
    guest = spark.createDataFrame(goes, "_r double, _first double, _before double")
    own = F.struct(F.col("_range").alias("to"), F.lit(False).alias("guest"))
    away = F.struct(F.col("_before").alias("to"), F.lit(True).alias("guest"))
    both = base.join(F.broadcast(guest), (F.col("_range") == F.col("_r")), "left").withColumn("_v", F.explode(F.when(F.col("_key") == F.col("_first"), F.array(own, away)).otherwise(F.array(own))))
    out = both.select("doc_id", "text", F.col("_v.to").alias("_to"), F.col("_v.guest").alias("_guest"))
    return out.repartition(parts(spark), "_to").sortWithinPartitions("_to", "_guest", F.asc_nulls_first("doc_id"), "text")


def compare(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    common_prefix (code points that text and edited text share at their beginning).

    A null text is the empty one: n_chars 0, its edited text is empty. Documents follow each other by ascending
    doc_id (null first), equal ones by their text's bytes; a single document is its own successor. Other columns
    are ignored; an empty table gives an empty one.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the last row so far, whose successor comes with the next slice
        seen = None
        for b in batches:
            if not b.num_rows:
                continue
            data, off = texts(b)
            ids = b.column(0)
            to = b.column(2).to_numpy(zero_copy_only=False)
            guest = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in spans(off, SLICE):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                t, g, k = to[i:j], guest[i:j], ids.slice(i, j - i)
                if left is not None:
                    d, o = np.concatenate([left[0], d]), np.concatenate([[0], o + len(left[0])])
                    t, g, k = np.append(left[1], t), np.append(left[2], g), pa.concat_arrays([left[3], k])
                emit = np.zeros(len(t), bool)
                emit[:-1] = ~g[:-1]
                rows, *cols = prints(d, o, emit)
                if len(rows):
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
                    yield pa.record_batch([k.take(pa.array(rows)), *(pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True))], NAMES)
                left = (d[o[-2] : o[-1]].copy(), t[-1], g[-1], k.slice(len(t) - 1, 1))
                seen = g[-1]
        assert seen is None or seen, "a range ends with its guest"

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ring(docs).mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return compare(docs)
