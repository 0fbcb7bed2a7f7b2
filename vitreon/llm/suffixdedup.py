"""Removal of repeated 200-byte strings by a distributed difference-cover suffix algorithm, pruned to repeats.

Only whether two suffixes agree on their first LENGTH bytes matters, so names stand for equality instead of rank,
and suffixes whose name stands once are dropped at every stage instead of being sorted further:

1. Sample. D is a difference cover modulo V: whatever two positions i and j, some shift below V brings both to
   residues in D. Sampled suffixes are named by their first LENGTH - V bytes. Two equal strings of LENGTH bytes
   contain, at that shift, two sampled suffixes of equal name; a sample of unique name can prove nothing.
2. Recursion on names. The name of p and the name of p + V together cover LENGTH bytes, so the pair names the whole
   string at p; pairs that stand twice are repeats, and the bytes below them are settled.
3. Merge of the remaining suffixes. A string that starts at no sampled position is only a repeat if a repeated sample
   lies less than V behind its start. These strings are named; those that reach beyond settled bytes ask, the others
   are witnesses: adjacent equal names in the sorted order prove a repeat.

Names are as wide as the corpus needs: first names have the logarithm of their number and SPARE_FIRST bits, since a
collision there only costs work; whole strings have twice the logarithm of their number and SPARE bits, so that two
different strings of the whole corpus share a name with a chance of 2**-SPARE, whatever its size (128 bits at most, of
two independent hashes). Sorted runs of names are compressed by difference and dealt by range, in ranges whose number
grows with the input; a run holds a name once, so a passage that a third of all documents hold costs one entry a map
task. Equal documents are one class throughout: a class of two and more documents is a repeat as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ranges
from .fingerprints import MODULI, Prefixes
from .common import FOUND, Scratch, Slices, parts, parts_for, prefix_hash, release, repeated, span_hash, spans, texts, tidy, unpack

LENGTH = 200
#: A perfect difference set modulo V (fixed values): every residue is a difference of two of its members.
V = 91
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
FIRST = LENGTH - V
#: Bytes of text that are hashed at once; longer texts go through in pieces of so many, a multiple of V.
SLICE = (1 << 19) // V * V
#: Bits of names beyond those that tell the strings of the corpus apart.
SPARE_FIRST, SPARE = 8, 20
#: Bits of the number that stands for a text; texts that share it get others.
OWNER_BITS = 64


def widths(size: int) -> tuple[int, int, int]:
    """Bits of first names, of whole names, and of the second hash beside those, for texts of this many bytes."""
    log = max(1, size).bit_length()
    return min(64, max(24, log + SPARE_FIRST)), 64, min(62, max(0, 2 * log + SPARE - 64))


class Names:
    """Hashes and second hashes of spans of a byte array."""

    def __init__(self, data: np.ndarray, extra: int):
        self.first = prefix_hash(data)
        self.second = Prefixes(data, MODULI[: 1 + (extra > 31)]) if extra else None

    def of(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray | None]:
        h = span_hash(self.first, at, at + length)
        if self.second is None:
            return h, None
        v = self.second.values(at, at + length)
        return h, v[0] << np.uint64(33) | (v[1] << np.uint64(2) if len(v) > 1 else np.uint64(0))


def is_cover(cover: tuple[int, ...], v: int) -> bool:
    return {(a - b) % v for a in cover for b in cover} == set(range(v))


def pieces(off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, lo, hi): the rows i to j - 1 with all their positions, or one long row with its positions from lo to hi."""
    for i, j in spans(off, SLICE):
        n = int(off[j] - off[i])
        for lo in range(0, max(n, 1), SLICE) if j == i + 1 else (0,):
            yield i, j, lo, lo + SLICE if j == i + 1 else n


def sampled(n: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions p of texts of n bytes with p + need <= n, one after another, and how many each has."""
    most = max(0, int(n.max(initial=0)) - need + 1)
    at = (np.arange((most + V - 1) // V)[:, None] * V + np.array(COVER)).ravel()
    size = np.searchsorted(at, np.maximum(n - need + 1, 0))
    return at[ranges(np.zeros(len(n), np.int64), size)], size


def _text_key(sha: list[bytes], other: dict[bytes, int] | None = None) -> np.ndarray:
    key = np.frombuffer(b"".join(s[:8] for s in sha), "<i8") >> np.int64(64 - OWNER_BITS)
    if other:
        key = np.array([other.get(s, k) for s, k in zip(sha, key.tolist(), strict=True)], np.int64)
    return key


def other_owners(classes: DataFrame) -> dict[bytes, int]:
    """Numbers of the texts that share theirs with another: about the square of the number of texts over 2**65."""
    shared = classes.groupBy("owner").agg(F.count("*").alias("c"), F.min("sha256").alias("keep")).where("c > 1")
    rows = classes.join(shared.hint("merge"), "owner").where("sha256 <> keep").select("sha256").collect()
    sha = [bytes.fromhex(r["sha256"]) for r in rows]
    return {s: int.from_bytes(hashlib.sha256(s).digest()[:8], "little", signed=True) for s in sha}


def survey(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, sha256, owner (a number for the text)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = texts(b)
            sha = [hashlib.sha256(data[i:j]).digest() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [b.column(0), pa.array(np.diff(off)), pa.array([s.hex() for s in sha], pa.string()), pa.array(_text_key(sha) if sha else [], pa.int64())],
                ["doc_id", "n_bytes", "sha256", "owner"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, sha256 string, owner bigint")


def first_names(docs: DataFrame, n_parts: int, bits: int, other: dict[bytes, int]) -> DataFrame:
    buckets = parts(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Slices(n_parts, bits, buckets=buckets)
        for b in batches:
            data, off = texts(b)
            sha = [hashlib.sha256(data[x:y]).digest() if y - x >= LENGTH else bytes(32) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            owner = _text_key(sha, other)
            for i, j, lo, hi in pieces(off):
                o = off[i : j + 1] - off[i]
                size = np.diff(o)
                # a piece sees FIRST - 1 bytes beyond its positions
                n = np.where(size >= LENGTH, np.minimum(size - lo, hi - lo + FIRST - 1), 0)
                if not n.any():
                    continue
                p, many = sampled(n, FIRST)
                g = p + np.repeat(o[:-1], many)
                yield from s.add(owner[i:j], many, span_hash(prefix_hash(data[off[i] + lo : min(off[j], off[i] + hi + FIRST)]), g, g + FIRST), p + lo)
        yield from s.flush()

    return docs.mapInArrow(run, FOUND)


def _places(col) -> list[np.ndarray]:
    return [unpack(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in col.to_pylist()]


def whole_names(held: DataFrame, n_parts: int, bits: int, extra: int) -> DataFrame:
    """held: owner, text, a (places of repeated first names). Strings of LENGTH bytes at p where p and p + V are such."""
    buckets = parts(held.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Slices(n_parts, bits, extra=extra, buckets=buckets)
        for b in batches:
            data, off = texts(b)
            owner, places = b.column(0).to_numpy(), _places(b.column(2))
            for i, j, lo, hi in pieces(off):
                names, at, who = Names(data[off[i] + lo : min(off[j], off[i] + hi + LENGTH)], extra), [], []
                for r in range(i, j):
                    p = places[r]
                    p = p[np.isin(p + V, p, assume_unique=True)]
                    p = p[(p >= lo) & (p < hi)]
                    at.append(p)
                    who.append(len(p))
                p = np.concatenate(at)
                h, second = names.of(p - lo + np.repeat(off[i:j] - off[i], who), LENGTH)
                yield from s.add(owner[i:j], who, h, p, second=second)
        yield from s.flush()

    return held.select("owner", "text", "a").mapInArrow(run, FOUND)


def _covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Whether strings from these starts on, some before 0 or beyond n, cover the bytes 0 to n - 1."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.clip(starts, 0, n), 1)
    np.add.at(step, np.clip(starts + LENGTH, 0, n), -1)
    return np.cumsum(step[:-1]) > 0


def other_names(held: DataFrame, n_parts: int, bits: int, extra: int) -> DataFrame:
    """held: owner, text, a, s (places of repeated whole strings). All other strings that may be repeats."""
    buckets = parts(held.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Slices(n_parts, bits, extra=extra, buckets=buckets)
        for b in batches:
            data, off = texts(b)
            owner, firsts, settled = b.column(0).to_numpy(), _places(b.column(2)), _places(b.column(3))
            for i, j, lo, hi in pieces(off):
                names = Names(data[off[i] + lo : min(off[j], off[i] + hi + LENGTH)], extra)
                ask, see, who = [], [], []
                for r in range(i, j):
                    # the row's starts from lo on, and the bytes that their strings cover
                    starts = min(int(off[r + 1] - off[r]) - LENGTH + 1, hi) - lo
                    if starts <= 0:
                        who.append(0)
                        continue
                    # starts with a repeated sample at most V - 1 behind
                    a = firsts[r][(firsts[r] >= lo) & (firsts[r] < lo + starts + V)] - lo
                    near = np.zeros(starts + V + 1, np.int32)
                    np.add.at(near, np.maximum(a - V + 1, 0), 1)
                    np.add.at(near, a + 1, -1)
                    start = np.flatnonzero(np.cumsum(near[:starts]) > 0)
                    s = settled[r][(settled[r] > lo - LENGTH) & (settled[r] < lo + starts + LENGTH)] - lo
                    bare = np.concatenate([np.zeros(1, np.int64), np.cumsum(~_covered(starts + LENGTH, s))])
                    new = bare[start + LENGTH] > bare[start]
                    ask.append(start[new] + lo)
                    see.append(start[~new] + off[r] - off[i])
                    who.append(int(new.sum()))
                p, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ask, see))
                h, second = names.of(p - lo + np.repeat(off[i:j] - off[i], who), LENGTH)
                seen, seen_second = names.of(w, LENGTH)
                yield from out.add(owner[i:j], who, h, p, seen, second, seen_second)
        yield from out.flush()

    return held.select("owner", "text", "a", "s").mapInArrow(run, FOUND)


def cut(held: DataFrame) -> DataFrame:
    """held: owner, text, s, u (places of repeats). The text without the bytes that they cover."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = texts(b)
            settled, others, rows = _places(b.column(2)), _places(b.column(3)), []
            for r in range(b.num_rows):
                text = data[off[r] : off[r + 1]]
                gone = _covered(len(text), np.concatenate([settled[r], others[r]]))
                kept = text[~gone].tobytes()
                rows.append((int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0, hashlib.sha256(kept).hexdigest(), kept))
            n, k, h, t = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(h, pa.string()), pa.array(t, pa.binary())], ["owner", "n_removed", "n_spans", "kept_sha256", "kept"])

    return held.select("owner", "text", "s", "u").mapInArrow(run, "owner bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (with_text: also kept, the remaining bytes).

    A byte goes if a string of LENGTH bytes over it also starts elsewhere, in this document or another; strings don't
    cross documents and are judged on the input. A null text is the empty one; texts shorter than LENGTH bytes lose
    nothing; rows with equal texts, repeated rows included, are documents of their own and lose everything. A
    null doc_id passes through; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    info = scratch.keep(survey(raw), "survey")
    grouped = lambda t: t.groupBy("owner", "sha256", "n_bytes").agg(F.min(F.struct("doc_id")).getField("doc_id").alias("id"), F.count("*").alias("rows"))
    classes = scratch.keep(grouped(info), "classes")
    if other := other_owners(classes):
        new = spark.createDataFrame([(s.hex(), o) for s, o in other.items()], "sha256 string, _other bigint")
        info = info.join(F.broadcast(new), "sha256", "left").withColumn("owner", F.coalesce("_other", "owner")).drop("_other")
        classes = scratch.keep(grouped(info), "classes")
    size = classes.agg(F.sum("n_bytes")).first()[0] or 0
    first, whole, extra = widths(size)
    n, buckets = parts_for(spark, size * len(COVER) // V), parts(spark)
    a = scratch.keep(repeated(first_names(raw, n, first, other), n, buckets=buckets).withColumnRenamed("places", "a"), "a")
    release(spark)
    # one row of every class that may hold a repeat; the texts move once, in a plan that is the same at all sizes
    wanted = classes.join(a, "owner").select(F.col("id").alias("_id"), F.col("sha256").alias("_sha"), "owner", "n_bytes", "a")
    keyed = raw.withColumn("_s", F.sha2("text", 256)).where(F.octet_length("text") >= LENGTH)
    held = keyed.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_sha")))
    held = scratch.keep(held.dropDuplicates(["doc_id", "_s"]).select("owner", "n_bytes", "text", "a"), "held")
    scratch.drop(a)
    release(spark)
    size = held.agg(F.sum("n_bytes")).first()[0] or 0
    n = parts_for(spark, size * len(COVER) // V)
    s = scratch.keep(repeated(whole_names(held, n, whole, extra), n, buckets=buckets).withColumnRenamed("places", "s"), "s")
    more = scratch.keep(held.join(s.hint("merge"), "owner", "left"), "more")
    scratch.drop(held, s)
    release(spark)
    n = parts_for(spark, size)  # as many strings as bytes at most
    u = scratch.keep(repeated(other_names(more, n, whole, extra), n, buckets=buckets).withColumnRenamed("places", "u"), "u")
    release(spark)
    last = more.drop("a").join(u.hint("merge"), "owner", "left")
    done = scratch.keep(cut(last.where("s is not null or u is not null")) if with_text else cut(last.where("s is not null or u is not null")).drop("kept"), "cut")
    scratch.drop(more, u)
    labels = classes.join(done.hint("merge"), "owner", "left").select(F.col("owner").alias("_o"), "rows", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
    labels = scratch.keep(labels, "labels")
    scratch.drop(classes, done)
    out = info.join(labels, F.col("owner") == F.col("_o"))
    copy = (F.col("rows") > 1) & (F.col("n_bytes") >= LENGTH)
    cols = [
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    ]
    out = out.select("doc_id", "n_bytes", *cols, *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "sha256"] if with_text else []))
    if not with_text:
        return out
    back = raw.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"), F.sha2(F.coalesce("text", F.lit(b"")), 256).alias("_x")).dropDuplicates(["_d", "_x"])
    out = out.join(back, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("sha256") == F.col("_x")))
    return out.withColumn("kept", F.coalesce("kept", "_t", F.lit(b""))).drop("_d", "_t", "_x", "sha256")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup(docs)


#: The same rows in DuckDB's SQL: every string of every text is compared by its MD5.
ORACLE = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, row_number() OVER (ORDER BY doc_id, text) AS r FROM documents),
n AS (SELECT *, octet_length(b) AS n FROM d),
s AS (SELECT r, b, unnest(range(n - {LENGTH - 1})) AS i FROM n WHERE n >= {LENGTH}),
k AS (SELECT r, i, md5(b[i + 1:i + {LENGTH}]) AS h FROM s),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM k) WHERE c > 1),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM f),
u AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g),
m AS (SELECT r, run, min(i) AS a, max(i) + {LENGTH} AS z FROM u GROUP BY ALL),
p AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS y FROM m),
e AS (SELECT p.r, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, max(z) AS last, string_agg(hex(b[y + 1:a]), '' ORDER BY a) AS kept FROM p JOIN n ON n.r = p.r GROUP BY p.r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN e.r IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(b[last + 1:n]))) END AS kept_sha256
FROM n LEFT JOIN e ON e.r = n.r
"""
