"""What the text operators share: tables, cut lineage, byte-level helpers and components."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks of the words of the contracts, as bytes: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_roots: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables in the folder that spark.checkpoint.dir names: they cut lineage and outlive executors.

    Tables that later steps no longer read are dropped; those that a returned DataFrame reads stay until sweep().
    Without a shared folder only a single machine can go on, in a temporary folder of its own.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            base = tempfile.mkdtemp(prefix="vitreon-")
            _roots[base] = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        self.kept: set[str] = set()
        _roots[self.root] = spark

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.kept.add(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete kept tables that nothing lazy still reads."""
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path in self.kept:
                self.kept.discard(path)
                _delete(self.spark, path)

    def only(self, *frames: DataFrame) -> None:
        """Delete all kept tables but these, which a result reads."""
        wanted = {df._scratch_path for df in frames}
        for path in self.kept - wanted:
            _delete(self.spark, path)
        self.kept &= wanted


def roots() -> set[str]:
    """The scratch folders there are."""
    return set(_roots)


def sweep(but: set[str] = frozenset()) -> None:
    """Delete the scratch folders of this process; call it when the results that read them have been used or stored."""
    for root in _roots.keys() - but:
        spark = _roots.pop(root)
        if spark.sparkContext._jsc is not None:
            _delete(spark, root)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- Python workers ---------------------------------------------------------------------------------


def trim() -> None:
    """Give freed memory back: an idle Python worker shares its executor's memory with later stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function over batches that trims when its partition ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


# --- Arrow and bytes -----------------------------------------------------------------------------


def texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array and n+1 offsets, without a Python object per row; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_binary())
    elif not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    n = len(col)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes (one longer row alone), to bound working memory."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, bijective, in place."""
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= _MIX1
        h ^= h >> np.uint64(27)
        h *= _MIX2
        h ^= h >> np.uint64(31)
    return h


BASE = np.uint64(6364136223846793005)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_rng = np.random.Generator(np.random.PCG64(20240501))
BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _POW.get(str(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(p, out=p)
        if size > 1 << 22:  # very long texts: not worth keeping
            return p[:n]
        _POW[str(base)] = have = p
    return have[:n]


def prefix_hash(data: np.ndarray, keys: np.ndarray = BYTE_KEYS) -> np.ndarray:
    """n+1 prefix sums of key[byte] * BASE**i; any span hash is a difference scaled by BASE**-start."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(keys[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(len(prefix), BASE_INV)[start])


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array (callers keep rows apart with blanks)."""
    solid = np.empty(len(data) + 2, np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~_BLANK[data]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Bytes of a longer text that are hashed at once.
PIECE = 1 << 20


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every word of the rows data[off[i]:off[i+1]], and the words' row numbers."""
    if len(off) == 2 and len(data) > 2 * PIECE:  # a long text goes through in pieces that end at blanks
        found, lo = [], 0
        while lo < len(data):
            hi = min(lo + PIECE, len(data))
            while hi < len(data) and not _BLANK[data[hi]]:
                hi += 1
            found.append(_word_hashes(data[lo:hi], np.array([0, hi - lo]), lower)[0])
            lo = hi
        h = np.concatenate(found)
        return h, np.zeros(len(h), np.int64)
    return _word_hashes(data, off, lower)


def _word_hashes(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(off) - 1
    gaps = np.arange(n, dtype=np.int64)
    flat = np.full(len(data) + n, 0x20, np.uint8)
    rows = np.repeat(gaps, np.diff(off))
    flat[np.arange(len(data)) + rows] = _LOWER[data] if lower else data
    starts, ends = word_bounds(flat)
    h = span_hash(prefix_hash(flat), starts, ends)
    row = np.searchsorted(off[1:] + gaps + 1, starts, "right")
    return h, row


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within a row, and n_rows + 1 offsets; repeats and the text's order are kept.

    A row with fewer than k words has its whole sequence as its only shingle; without words it has none.
    """
    size = np.bincount(row, minlength=n_rows)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    made = np.where(size >= k, size - k + 1, size > 0)
    off = np.concatenate([np.zeros(1, np.int64), np.cumsum(made)])
    out = np.zeros(off[-1], np.uint64)
    short = np.flatnonzero((size > 0) & (size < k))
    m = len(h) - k + 1

    def fold(x, v):
        x = (x ^ v) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    with np.errstate(over="ignore"):
        if m > 0:
            acc = np.zeros(m, np.uint64)
            for j in range(k):
                acc = fold(acc, h[j : j + m])
            full = np.ones(len(out), bool)
            full[off[short]] = False
            out[full] = acc[row[:m] == row[k - 1 :]]
        for r in short.tolist():
            x = np.zeros(1, np.uint64)
            for v in h[first[r] : first[r + 1]]:
                x = fold(x, v)
            out[off[r]] = x[0]
    return mix(out), off


def sort_rows(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the rows' new offsets."""
    h = h.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[off[:-1][off[:-1] < len(h)]] = True
    return h[fresh], np.concatenate([np.zeros(1, np.int64), np.cumsum(fresh)])[off]


def pack(h: np.ndarray, ascending: bool = True) -> bytes:
    """Unsigned numbers as zstd-compressed byte planes, of their differences if they ascend."""
    import zstandard

    d = (np.diff(h, prepend=h[:1] * 0) if ascending else h).astype("<u8")
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    used = max(1, int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unpack(blob: bytes, ascending: bool = True) -> np.ndarray:
    import zstandard

    used = blob[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(used, -1)
    planes = np.zeros((raw.shape[1], 8), np.uint8)
    planes[:, :used] = raw.T
    out = planes.reshape(-1).view("<u8")
    return np.cumsum(out, dtype=np.uint64) if ascending else out


# --- which hashes stand more than once ------------------------------------------------------------

#: Hashes of a slice of owners that a map task combines before it sends them on: at least so many, and with many parts
#: so many a part, up to MOST_COMBINED.
COMBINE, A_PART, MOST_COMBINED = 2 << 20, 128, 12 << 20
#: Hashes of a part, which a reducer holds at once, on average.
PART = 3 << 20
FOUND = "part int, owners array<bigint>, hashes binary, extra binary, places binary"


def parts_for(spark: SparkSession, hashes: int) -> int:
    """Parts that this number of hashes is dealt to: as the input grows there are more, not larger ones."""
    return max(parts(spark), -(-hashes // PART))


class Slices:
    """Map side of `repeated`: gathers (owner, hashes), combines a slice, and yields its rows of schema FOUND.

    A hash that stands twice in the slice is known to be repeated: its owners' rows (parts from n on) are final, and
    one entry without an owner tells the others. So a hash that a third of all owners hold costs one entry a slice.
    Hashes of `witness` are only met by others and get no answer, which saves their owners and places. Answers leave in
    buckets of owners, as many as parts unless told otherwise. bits are kept of the hashes, and extra bits of the second hashes that some callers give beside them; equal are those that agree in both.
    """

    def __init__(self, n_parts: int, bits: int = 64, give: str = "places", extra: int = 0, buckets: int | None = None):
        self.n, self.bits, self.give, self.extra = n_parts, bits, give, extra
        self.most = max(COMBINE, min(MOST_COMBINED, A_PART * n_parts))
        self.buckets = n_parts if buckets is None else buckets
        self.held: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray | None]] = []
        self.ids: list[np.ndarray] = []
        self.n_ids = self.size = 0

    def add(self, owners: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, places: np.ndarray, witness: np.ndarray | None = None, second: np.ndarray | None = None, witness_second: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """owners, sizes: ids and how many of the hashes each has, one after another; places: a number below 2**32 that comes
        back with a repeated hash."""
        new = len(hashes) + (len(witness) if witness is not None else 0)
        if self.size and self.size + new > self.most:
            yield from self.flush()
        self.held.append((hashes, second, np.repeat(np.arange(self.n_ids, self.n_ids + len(owners), dtype=np.int32), sizes), places.astype(np.uint32)))
        self.ids.append(owners)
        self.n_ids += len(owners)
        self.size += new
        if witness is not None and len(witness):
            self.held.append((witness, witness_second, None, None))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        held, ids, self.held, self.ids, self.n_ids, self.size = self.held, np.concatenate(self.ids), [], [], 0, 0
        h = np.concatenate([x[0] for x in held])
        who = np.concatenate([np.full(len(x[0]), -1, np.int32) if x[2] is None else x[2] for x in held])  # -1: a witness
        place = np.concatenate([np.zeros(len(x[0]), np.uint32) if x[3] is None else x[3] for x in held])
        second = np.concatenate([x[1] for x in held]) >> np.uint64(64 - self.extra) if self.extra else None
        del held
        if self.bits < 64:
            h = h >> np.uint64(64 - self.bits)
        order = by_name(h, second)
        h, who, place = h[order], who[order], place[order]
        if second is not None:
            second = second[order]
        at = np.flatnonzero(fresh(h, second))
        size = np.diff(np.append(at, len(h)))
        twice = np.repeat(size > 1, size) & (who >= 0)
        what = answer(h[twice], place[twice].astype(np.uint64), self.give)
        # settled rows go past a reducer untouched; parts from n on say so and name the owners' bucket
        rows = [(self.n + k, o, pack(c, False), None, pack(p, False)) for k, o, c, p in bucketed(ids[who[twice]], what, self.buckets)]
        mark = (size > 1) | (who[at] < 0)
        h, who, place = h[at], np.where(mark, -1, who[at]), np.where(mark, np.uint32(0), place[at]).astype(np.uint64)
        second = second[at] if second is not None else None
        # part by the hash's leading bits: a part is a range of hashes
        low = min(24, self.bits)
        part = (h >> np.uint64(self.bits - low)) * np.uint64(self.n) >> np.uint64(low)
        cuts = np.searchsorted(part, np.arange(self.n + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[k], cuts[k + 1]
            w = who[a:b]
            if b - a < len(ids):
                some, local = np.unique(w, return_inverse=True)
                local = local + (some[0] >= 0)
                some = some[some >= 0]
            else:
                there = np.zeros(len(ids) + 1, bool)
                there[w + 1] = True
                there[0] = False
                some, local = np.flatnonzero(there) - 1, np.cumsum(there)[w + 1] * (w >= 0)
            rows.append((k, ids[some], pack(h[a:b]), pack(second[a:b], False) if second is not None else None, pack(local.astype(np.uint64) << np.uint64(32) | place[a:b], False)))
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        for i in range(0, len(rows), 2000):
            some = list(zip(*rows[i : i + 2000], strict=True))
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(some, kinds, strict=True)], ["part", "owners", "hashes", "extra", "places"])


def by_name(h: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    """The order by hash and second hash; the second rarely matters."""
    order = np.argsort(h)
    if second is not None:
        x, y = h[order], second[order]
        if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
            return np.lexsort((second, h))
    return order


def fresh(h: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    """Whether each of the sorted entries differs from the one before."""
    out = np.ones(len(h), bool)
    out[1:] = h[1:] != h[:-1]
    if second is not None:
        out[1:] |= second[1:] != second[:-1]
    return out


def answer(h: np.ndarray, place: np.ndarray, give: str) -> np.ndarray:
    """What comes back for a repeated hash: its place, or its upper 48 bits and the place (65,535 at most) below."""
    return place if give == "places" else h & ~np.uint64(0xFFFF) | np.minimum(place, np.uint64(0xFFFF))


def bucketed(owner: np.ndarray, value: np.ndarray, n: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, distinct owners, their numbers of values, values) by bucket of owners, sorted by owner and value."""
    if not len(owner):
        return []
    order = np.lexsort((value, owner, owner % n))
    owner, value = owner[order], value[order]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    size = np.diff(np.append(first, len(owner))).astype(np.uint64)
    ids = owner[first]
    cut = np.flatnonzero(np.append(True, (ids % n)[1:] != (ids % n)[:-1]))
    out = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)], strict=True):
        lo, hi = first[a], first[b] if b < len(first) else len(owner)
        out.append((int(ids[a] % n), ids[a:b], size[a:b], value[lo:hi]))
    return out


def repeated(found: DataFrame, n: int, give: str = "places", buckets: int | None = None, then=None, schema: str = "owner bigint, places binary") -> DataFrame:
    """(owner, places) of every hash of `found` (rows of Slices for n parts and these buckets) that stands more than once:
    ascending distinct places, packed; with give="hashes" the hashes' upper 48 bits above their places.

    then, a function of all owners (one a value) and values of a bucket, makes other rows of them, of this schema.

    A part is a range of hash values, of which a reducer sees one entry a slice and hash at most. Its answers leave by
    buckets of owners, and a second exchange brings each owner's together.
    """
    answers = "bucket int, owners array<bigint>, sizes binary, places binary"
    buckets = n if buckets is None else buckets

    def rows(packed: list) -> pa.Table:
        return pa.table({
            "bucket": pa.array([r[0] for r in packed], pa.int32()),
            "owners": pa.array([r[1] for r in packed], pa.list_(pa.int64())),
            "sizes": pa.array([pack(r[2], False) for r in packed], pa.binary()),
            "places": pa.array([pack(r[3], False) for r in packed], pa.binary()),
        })

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part >= n:
            return pa.table({"bucket": pa.array([part - n] * len(table), pa.int32()), "owners": table.column("owners"), "sizes": table.column("hashes"), "places": table.column("places")})
        hs, seconds, whos, places, base, all_ids = [], [], [], [], 0, []
        for own, h, x, w in zip(table.column("owners"), table.column("hashes"), table.column("extra"), table.column("places"), strict=True):
            ids = own.values.to_numpy()
            w = unpack(w.as_py(), False)
            who = (w >> np.uint64(32)).astype(np.int64)
            hs.append(unpack(h.as_py()))
            if x.is_valid:
                seconds.append(unpack(x.as_py(), False))
            whos.append(np.where(who == 0, -1, who - 1 + base))
            places.append(answer(hs[-1], w & np.uint64(0xFFFFFFFF), give))
            all_ids.append(ids)
            base += len(ids)
        h, who, place, ids = (np.concatenate(x) for x in (hs, whos, places, all_ids))
        second = np.concatenate(seconds) if seconds else None
        order = by_name(h, second)
        at = np.flatnonzero(fresh(h[order], second[order] if second is not None else None))
        size = np.diff(np.append(at, len(h)))
        hit = order[np.repeat(size > 1, size)]
        hit = hit[who[hit] >= 0]
        # a hash marked by one slice as repeated is settled there; its other slices' entries meet it here
        return rows(bucketed(ids[who[hit]], place[hit], buckets))

    def merge(table: pa.Table) -> pa.Table:
        owner = np.concatenate([np.repeat(o.values.to_numpy(), unpack(c.as_py(), False).astype(np.int64)) for o, c in zip(table.column("owners"), table.column("sizes"), strict=True)])
        value = np.concatenate([unpack(p.as_py(), False) for p in table.column("places")])
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        fresh = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]))
        owner, value = owner[fresh], value[fresh]
        if then is not None:
            return then(owner, value)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        ends = [*first[1:].tolist(), len(owner)]
        return pa.table({"owner": pa.array(owner[first]), "places": pa.array([pack(value[a:b]) for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())})

    return found.groupBy("part").applyInArrow(meet, answers).groupBy("bucket").applyInArrow(merge, schema)


# --- components ----------------------------------------------------------------------------------


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (u, v) reaches.

    Alternates large-star and small-star steps, which keep connectivity and end as stars around each smallest
    node after O(log n) rounds. Minima are pre-aggregated; the join back to a hub's edges is an equi-join with
    one row per hub on its other side, which AQE can split. Self-loops and nulls are ignored.
    """
    e = scratch.keep(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = scratch.keep(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        new = scratch.keep(small, "small")
        # done when every upper node has one lower neighbour and no lower node is itself an upper one
        n_new = new.agg(F.count("*").alias("n"), F.countDistinct("u").alias("u")).first()
        done = n_new.n == n_new.u and new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        scratch.drop(e, large)
        e = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
