"""Ranked lexical search: the k best documents for every item, by branch and bound over hierarchical max trees.

Documents are cut into segments, slices of a scan in which ids ascend. Of a segment only the postings of terms that items
hold are kept, each compared with the term's bytes and not by hash alone. Once N, L and the document frequencies are known,
every posting has its impact, and a tree is built over a segment's documents: a node covers 2**FAN of the level below and
holds, for each term below it, the highest impact. A node's bound for an item is the sum of its terms' weights times these
maxima. Search pops the node of the highest bound from a heap and opens it, until the bound is below the k-th score; nodes
whose bound equals that score are opened as well, since a document of equal score and lower id may lie there.

The segments' roots are the upper level of the same tree. First, for each item, the k segments of highest root bound are
searched, which gives a k-th score; then every other segment whose root bound reaches it. A task carries its best documents
from segment to segment, so it hands on k rows an item at most.

Items go in blocks of bounded size, which are broadcast; more items are more blocks, each a pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import ranges
from .common import BYTE_KEYS, PIECE, Scratch, mix, prefix_hash, span_hash, spans, texts, tidy

#: Documents that an item gets.
K = 10
#: A node covers so many of the level below: 2**FAN.
FAN = 3
#: Bytes of text and documents of a segment: its tree is a row, of which an executor's readers hold several.
SEGMENT, SEGMENT_DOCS = 4 << 20, 1 << 16
#: Items and bytes of their texts that a block has on average.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(data: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and hashes of the terms of a byte array, whose rows callers keep apart with blanks."""
    low = _LOWER[data]
    solid = np.zeros(len(low) + 2, np.int8)
    solid[1:-1] = _IN_TERM[low]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return low, starts, ends, span_hash(prefix_hash(low, keys), starts, ends)


class Vocabulary:
    """The distinct terms of a block of items, found in texts by hash and then compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.size = np.array([len(t) for t in terms], np.int64)
        self.first = np.cumsum(self.size) - self.size
        flat = np.frombuffer(b" ".join(terms), np.uint8)
        for seed in numbers():  # keys under which no two of these terms share a hash
            self.keys = mix(BYTE_KEYS + np.uint64(seed)) | np.uint64(1)
            h = terms_of(flat, self.keys)[3]
            self.order = np.argsort(h)
            self.hashes = h[self.order]
            if (self.hashes[1:] != self.hashes[:-1]).all():
                break

    def __len__(self) -> int:
        return len(self.size)

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the given terms of those that are in the vocabulary, and their numbers."""
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        there = np.flatnonzero(self.hashes[at] == h) if len(self.hashes) else np.zeros(0, np.int64)
        term = self.order[at[there]]
        fits = ends[there] - starts[there] == self.size[term]
        there, term = there[fits], term[fits]
        size = self.size[term]
        equal = low[ranges(starts[there], size)] == self.data[ranges(self.first[term], size)]
        if not equal.all():
            whole = np.logical_and.reduceat(equal, np.cumsum(size) - size)
            there, term = there[whole], term[whole]
        return there, term


def _pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The rows' bytes, kept apart with blanks, in pieces: (bytes, row ends, first row). A long row goes in pieces that end at blanks."""
    for a, b in spans(off, PIECE):
        if b - a == 1:
            lo, end = int(off[a]), int(off[b])
            while lo < end:
                hi = min(lo + PIECE, end)
                while hi < end and _IN_TERM[data[hi]]:
                    hi += 1
                yield data[lo:hi], np.array([hi - lo]), a
                lo = hi
            continue
        n = b - a
        part, size = data[off[a] : off[b]], np.diff(off[a : b + 1])
        flat = np.full(len(part) + n, 0x20, np.uint8)
        flat[np.arange(len(part)) + np.repeat(np.arange(n), size)] = part
        yield flat, np.cumsum(size + 1), a


def read(data: np.ndarray, off: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms with repeats of every row; and row, term and occurrences of the vocabulary's terms, by row and term."""
    n = np.zeros(len(off) - 1, np.int64)
    keys, times, v = [], [], max(1, len(vocabulary))
    for flat, ends_of_rows, first in _pieces(data, off):
        low, starts, ends, h = terms_of(flat, vocabulary.keys)
        row = np.searchsorted(ends_of_rows, starts, "right") + first
        n[first : first + len(ends_of_rows)] += np.bincount(row - first, minlength=len(ends_of_rows))
        there, term = vocabulary.find(low, starts, ends, h)
        k, c = np.unique(row[there] * v + term, return_counts=True)
        keys.append(k)
        times.append(c)
    if not keys:
        return n, *(np.zeros(0, np.int64),) * 3
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.zeros(len(k), np.int64)
    np.add.at(tf, at, np.concatenate(times))
    return n, k // v, k % v, tf


_SEGMENT = "seg bigint, n_docs bigint, n_terms bigint, ids array<{}>, sizes binary, terms array<int>, df array<bigint>, docs binary, term binary, tf binary"


def segments(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row a segment: documents with a term and their terms in all, ids and sizes, document frequencies, postings."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, voc = TaskContext.get().partitionId() << 32, shared.value
        held: list[tuple[list, tuple]] = []
        made = size = 0

        def close() -> pa.RecordBatch:
            ids = [i for part, _ in held for i in part]
            n = np.concatenate([x[0] for _, x in held])
            first = np.cumsum([0] + [len(part) for part, _ in held])
            row, term, tf = (np.concatenate([x[k] + (a if k == 1 else 0) for a, (_, x) in zip(first, held)]) for k in (1, 2, 3))  # noqa: B905
            # ids ascend in a segment, nulls last; documents without a term are left out
            order = [j for j in sorted(range(len(ids)), key=lambda j: (ids[j] is None, ids[j] if ids[j] is not None else 0)) if n[j]]
            place = np.full(len(ids), -1)
            place[order] = np.arange(len(order))
            row = place[row]
            by = np.lexsort((row, term))
            row, term, tf = row[by], term[by], tf[by]
            some, df = np.unique(term, return_counts=True)
            cols = [base + made, len(order), int(n.sum()), [ids[j] for j in order], n[order].astype("<i8").tobytes(), some.astype(np.int32), df, row.astype("<i4").tobytes(), term.astype("<i4").tobytes(), tf.astype("<i8").tobytes()]
            return pa.record_batch([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names)

        names = [c.split()[0] for c in _SEGMENT.split(", ")]
        types = None
        for b in batches:
            if types is None:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(b.column(0).type), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            data, off = texts(b)
            for a, z in spans(off, SEGMENT):
                if held and (size + off[z] - off[a] > SEGMENT or sum(len(p) for p, _ in held) + z - a > SEGMENT_DOCS):
                    yield close()
                    held, made, size = [], made + 1, 0
                held.append((b.column(0).slice(a, z - a).to_pylist(), read(data[off[a] : off[z]], off[a : z + 1] - off[a], voc)))
                size += int(off[z] - off[a])
        if held:
            yield close()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(run, _SEGMENT.format(kind))


def build(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int, v: int, fan: int = FAN) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray]]:
    """Levels of the max tree over n documents, from the postings up, and the root's (terms, maxima).

    A level lists, by node and term, the children that hold the term: (node * v + term ascending, first of each and the end,
    child by its place in the node, its maximum).
    """
    levels, d = [], n
    while True:
        key = (doc >> fan) * v + term
        order = np.argsort(key, kind="stable")
        key, doc, impact = key[order], doc[order], impact[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        levels.append((key[at], np.append(at, len(key)), doc & ((1 << fan) - 1), impact))
        impact = np.maximum.reduceat(impact, at) if len(at) else impact
        doc, term = key[at] // v, key[at] % v
        d = (d + (1 << fan) - 1) >> fan
        if d <= 1:
            return levels, (term, impact)


def root_bound(root: tuple[np.ndarray, np.ndarray], terms: np.ndarray, weights: np.ndarray) -> int:
    at = np.searchsorted(root[0], terms)
    at[at == len(root[0])] = 0
    there = root[0][at] == terms if len(root[0]) else np.zeros(len(terms), bool)
    return int((weights[there] * root[1][at[there]]).sum())


def search_tree(levels: list[tuple], bound: int, terms: np.ndarray, weights: np.ndarray, v: int, k: int, least: int, have: list[int], fan: int = FAN) -> list[tuple[int, int]]:
    """(score, document) of those that can be among the k best, given a score that the k-th has at least and k best scores had so far.

    Of documents of equal score, those of lower numbers come first; terms ascend.
    """
    best = [s for s in have if s >= least]  # the k best scores so far, lowest first
    heapify(best)
    found: list[tuple[int, int]] = []
    heap = [(-bound, len(levels) - 1, 0)]
    while heap:
        b, level, node = heappop(heap)
        if -b < max(least, best[0] if len(best) == k else 1):
            break  # one that equals the k-th score is opened
        keys, first, child, most = levels[level]
        want = node * v + terms
        at = np.searchsorted(keys, want)
        at[at == len(keys)] = 0
        there = keys[at] == want
        at = at[there]
        size = first[at + 1] - first[at]
        where = ranges(first[at], size)
        sums = np.zeros(1 << fan, np.int64)
        np.add.at(sums, child[where], np.repeat(weights[there], size) * most[where])
        for c, s in enumerate(sums.tolist()):
            if s < max(least, best[0] if len(best) == k else 1):
                continue
            if level:
                heappush(heap, (-s, level - 1, (node << fan) + c))
                continue
            found.append((s, (node << fan) + c))
            heappush(best, s)
            if len(best) > k:
                heappop(best)
    floor = max(least, best[0] if len(best) == k else 1)
    return [x for x in found if x[0] >= floor]


_TREE = "seg bigint, ids array<{}>, levels array<struct<key:binary,size:binary,child:binary,most:binary>>, root_terms binary, root_most binary"


def _packed(level: tuple) -> dict[str, bytes]:
    """A level as bytes: an impact is below 10**6, and a node has few children."""
    key, first, child, most = level
    return {"key": key.astype("<i8").tobytes(), "size": np.diff(first).astype("<u2").tobytes(), "child": child.astype("<u2").tobytes(), "most": most.astype("<u4").tobytes()}


def _unpacked(level: dict[str, bytes]) -> tuple:
    key, size, child, most = (np.frombuffer(level[c], t) for c, t in (("key", "<i8"), ("size", "<u2"), ("child", "<u2"), ("most", "<u4")))
    return key, np.append(0, np.cumsum(size, dtype=np.int64)), child, most.astype(np.int64)


def trees(found: DataFrame, v: int, n_docs: int, n_terms: int) -> DataFrame:
    """One row a segment: the tree over its documents, with impacts by the corpus' numbers of documents and terms."""
    kind = found.schema["ids"].dataType.elementType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                sizes, doc, term, tf = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("sizes", "<i8"), ("docs", "<i4"), ("term", "<i4"), ("tf", "<i8")))
                if not len(doc):
                    continue
                if 75 * int(sizes.max()) * n_docs < 1 << 63:
                    m = 25 + 75 * sizes * n_docs // n_terms
                else:
                    m = np.array([25 + 75 * n * n_docs // n_terms for n in sizes.tolist()], np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                levels, root = build(doc.astype(np.int64), term.astype(np.int64), impact, len(sizes), v)
                packed = [_packed(level) for level in levels]
                cols = {"seg": b.column("seg").slice(i, 1), "ids": b.column("ids").slice(i, 1), "levels": pa.array([packed], pa.list_(_LEVEL)), "root_terms": pa.array([root[0].astype("<i8").tobytes()]), "root_most": pa.array([root[1].astype("<i8").tobytes()])}
                yield pa.record_batch(list(cols.values()), list(cols))

    return found.mapInArrow(run, _TREE.format(kind))


_LEVEL = pa.struct([(c, pa.binary()) for c in ("key", "size", "child", "most")])


class Queries:
    """The items of a block: for each, its terms that documents hold, ascending, with their weights times occurrences."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], v: int, k: int):
        self.items, self.v, self.k = items, v, k


def _highest_roots(made: DataFrame, shared) -> DataFrame:
    """item, seg: the k segments of highest root bound for each item."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for b in batches:
            for seg, t, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                root = (np.frombuffer(t, "<i8"), np.frombuffer(m, "<i8"))
                for i, (terms, weights) in enumerate(q.items):
                    if (bound := root_bound(root, terms, weights)) > 0:
                        heappush(best[i], (bound, seg))
                        if len(best[i]) > q.k:
                            heappop(best[i])
        rows = [(i, *x) for i, some in best.items() for x in some]
        for a in range(0, len(rows), 10_000):
            cols = list(zip(*rows[a : a + 10_000], strict=True))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["item", "bound", "seg"])

    rows = made.select("seg", "root_terms", "root_most").mapInArrow(run, "item bigint, bound bigint, seg bigint")
    top = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "seg"))
    return rows.withColumn("_n", top).where(F.col("_n") <= shared.value.k).select("item", "seg")


def _search(made: DataFrame, shared, least: dict[int, int], only: bool = False) -> DataFrame:
    """item, doc_id, score: of every task, the k best documents of each item whose k-th score is known to be least[item] or more.

    With only, a row's column items lists the items to search its segment for.
    """
    kind = made.schema["ids"].dataType.elementType.simpleString()
    floor = made.sparkSession.sparkContext.broadcast(least)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floors = shared.value, floor.value
        best: dict[int, list[tuple]] = defaultdict(list)
        types = None
        for b in batches:
            types = b.column("ids").type.value_type
            for r in range(len(b)):
                root = tuple(np.frombuffer(b.column(c)[r].as_py(), "<i8") for c in ("root_terms", "root_most"))
                levels = ids = None
                for i in b.column("items")[r].as_py() if only else range(len(q.items)):
                    terms, weights = q.items[i]
                    had = [x[0] for x in best[i]]
                    least_here = max(floors.get(i, 1), min(had) if len(had) == q.k else 1)
                    bound = root_bound(root, terms, weights)
                    if bound < least_here:
                        continue
                    if levels is None:
                        levels = [_unpacked(x) for x in b.column("levels")[r].as_py()]
                        ids = b.column("ids")[r].values
                    found = search_tree(levels, bound, terms, weights, q.v, q.k, least_here, had)
                    more = [(s, ids[d].as_py()) for s, d in found]
                    best[i] = sorted(best[i] + more, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[: q.k]
        rows = [(i, *x) for i, some in best.items() for x in some]
        for a in range(0, len(rows), 10_000):
            item, score, doc = zip(*rows[a : a + 10_000], strict=True)
            yield pa.record_batch([pa.array(item, pa.int64()), pa.array(doc, types), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    cols = ["ids", "levels", "root_terms", "root_most", *["items"] * only]
    return made.select(*cols).mapInArrow(run, f"item bigint, doc_id {kind}, score bigint")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def _block(docs: DataFrame, rows: list, k: int, scratch: Scratch) -> DataFrame | None:
    """item (its number in the block), doc_id, score, rank; None if no item can have a document."""
    spark = docs.sparkSession
    keys = BYTE_KEYS
    counted = []
    for r in rows:
        low, starts, ends, _ = terms_of(np.frombuffer(bytes(r["text"] or b""), np.uint8), keys)
        raw = low.tobytes()
        counted.append(Counter(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)))
    number = {t: i for i, t in enumerate(sorted({t for c in counted for t in c}))}
    if not number:
        return None
    found = scratch.keep(segments(docs, Vocabulary(list(number))), "segments")
    total = found.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    if not total.l:
        return None
    # a row a distinct term of the block at most
    df = {r.term: r.df for r in found.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2.0 * total.n + 2) / (2.0 * n + 1))) for t, n in df.items()}
    items = []
    for c in counted:
        have = sorted((number[t], n * weight[number[t]]) for t, n in c.items() if weight.get(number[t], 0))
        items.append((np.array([t for t, _ in have], np.int64), np.array([w for _, w in have], np.int64)))
    made = scratch.keep(trees(found, len(number), total.n, total.l), "trees")
    scratch.drop(found)
    shared = spark.sparkContext.broadcast(Queries(items, len(number), k))
    # k segments an item at most
    first = _highest_roots(made, shared).groupBy("seg").agg(F.collect_list("item").alias("items"))
    some = _ranked(_search(made.join(F.broadcast(first), "seg"), shared, {}, only=True), k)
    least = {r.item: r.least for r in some.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
    out = scratch.keep(_ranked(_search(made, shared, least), k).select("item", "doc_id", "score", "rank"), "best")
    scratch.drop(made)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (1 to k), doc_id, score: the k documents of highest score above 0 for every row of items.

    Terms are the longest runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. Equal scores
    go by ascending doc_id, rows without one last. Every row of documents is a document, repeated or not, a null doc_id
    included; null texts and texts without terms aren't counted. Rows of items are searched one by one, so a repeated item
    has its list as often; a null or empty text has none. Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    rows = scratch.keep(items.select("item_id", F.col("text").cast("binary").alias("text")).withColumn("_key", F.monotonically_increasing_id()), "items")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-size.bytes // BLOCK_BYTES))
    out = None
    for i in range(blocks):
        one = rows.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == i).orderBy("_key").collect() if blocks > 1 else rows.orderBy("_key").collect()
        found = _block(docs, one, k, scratch) if one else None
        if found is None:
            continue
        names = spark.createDataFrame([(j, r["item_id"]) for j, r in enumerate(one)], f"_item bigint, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = found.join(names, F.col("item") == F.col("_item")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    return out


def query(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


_TERMS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
ORACLE = f"""
WITH docs AS (
    SELECT doc_id, {_TERMS} AS terms, row_number() OVER () AS r FROM documents
), full_ AS (
    SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0
), stats AS (
    SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM full_
), tfs AS (
    SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM full_) GROUP BY r, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, stats GROUP BY term
), wanted AS (
    SELECT item_id, i, term, count(*)::BIGINT AS times FROM (SELECT item_id, row_number() OVER () AS i, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, i, term
), scores AS (
    SELECT item_id, i, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN full_ USING (r), stats GROUP BY item_id, i, r
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scores JOIN full_ USING (r) WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= {K}"""
