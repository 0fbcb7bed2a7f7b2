"""N-gram Jaccard join by grouped prefixes: exact links between documents whose shingle sets are alike.

1. Every shingle's number of documents is counted: map tasks send sorted, compressed hash runs by hash range, and
   a fixed-size table keeps the logarithm of the counts. It takes the counts from above until LOAD of its slots are
   used, so that however large the corpus, most slots are empty and the most frequent shingles are told from the rest.
   The table orders shingles from rare to common; any order gives right results, this one keeps the prefixes apart.
2. A document's prefix is its n - ceil(t * n) + 1 rarest shingles: sets with Jaccard >= t share one of it. Documents
   with the same prefix and size collapse into a group.
3. Groups that share a prefix shingle are candidates. A shingle that many groups share gives no pair of all its groups: each
   group meets the shingle's pivot of its own and of the next size band. Pairs are verified on the texts, verified links
   give components, and only shingles whose groups still lie in several components are looked at again: once more
   with other pivots, then with every remaining pair of near sizes across components. Pairs whose places of the shingle
   rule out the threshold are left out, as are pairs whose signatures do: a signature holds the parities of BITS buckets
   of a set, and two sets differ in at least as many members as their signatures differ in bits. So no link that
   joins two components is lost, a group of near copies costs pairs in proportion to its size, and of unlike
   documents that share a frequent shingle hardly a pair leaves the join.
4. Groups with several different sets expand to all of them before pairs are verified.

Sizes: the order table is fixed; every shuffle carries prefixes, ids, signatures or candidates. The texts of candidates
move to blocks of at most BLOCK partners of one text, which is sent and hashed once a block, not once a pair. A key that
a third of all documents share stands once a map task (shared shingles), once (pivots), or in an equi-join that
AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ranges
from .common import FOUND, Scratch, Slices, components, pack, parts, parts_for, release, repeated, shingles, sort_rows, spans, texts, tidy, unpack, word_hashes

#: Shingles and threshold of the operator unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: Bits of the hashes that are counted and of the order table's slots, the least count that it tells apart, and the share
#: of its slots that may be used.
COUNT_BITS, SLOT_BITS, LEAST, LOAD = 40, 22, 8, 0.125
SLOTS = 1 << SLOT_BITS
#: Bytes of text that are hashed at once, and shingles that a map task combines before sending.
SLICE, COMBINE = 1 << 20, 2 << 20
#: Bits of a signature, and partners that a text meets at once.
BITS, BLOCK = 512, 64


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*word_hashes(data, off), len(off) - 1, k)


def order_table(docs: DataFrame, k: int, scratch: Scratch) -> np.ndarray:
    """log2 of the shingles' document counts by slot of their leading bits (0 below those it holds): SLOTS bytes."""
    spark = docs.sparkSession
    n = parts_for(spark, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)  # a word takes about six bytes
    shift = np.uint64(64 - COUNT_BITS)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            part = (keys >> np.uint64(COUNT_BITS - SLOT_BITS)) * np.uint64(n) >> np.uint64(SLOT_BITS)
            cuts = np.searchsorted(part, np.arange(n + 1))
            rows = [(i, pack(keys[a:b]), pack(times[a:b].astype(np.uint64), False)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "keys", "times"])

        for b in batches:
            data, off = texts(b)
            for i, j in spans(off, SLICE):
                h, o = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                held.append(sort_rows(h >> shift, o)[0])
                size += len(held[-1])
                if size >= COMBINE:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    def level(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x.as_py()) for x in table.column("keys")])
        times = np.concatenate([unpack(x.as_py(), False) for x in table.column("times")]).astype(np.int64)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(times, first)
        often = total >= LEAST
        slot = (keys[first][often] >> np.uint64(COUNT_BITS - SLOT_BITS)).astype(np.int64)
        lev = np.log2(total[often]).astype(np.int64)
        have = np.unique(lev)
        slots = [np.unique(slot[lev == x]).astype(np.uint64) for x in have]
        return pa.table({"level": pa.array(have, pa.int32()), "n": pa.array([len(x) for x in slots], pa.int64()), "slots": pa.array([pack(x) for x in slots], pa.binary())})

    rows = (
        docs.select(F.col("text").cast("binary").alias("text"))
        .mapInArrow(count, "part int, keys binary, times binary")
        .groupBy("part")
        .applyInArrow(level, "level int, n bigint, slots binary")
    )
    # parts are ranges of slots, so each level has SLOTS entries at most
    rows = scratch.keep(rows, "levels")
    used, least = 0, LEAST.bit_length() - 1
    for r in rows.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        if used and used + r["n"] > LOAD * SLOTS:
            break
        used, least = used + r["n"], r["level"]
    table = np.zeros(SLOTS, np.uint8)
    for r in rows.where(F.col("level") >= least).orderBy("level").collect():
        table[unpack(bytes(r["slots"])).astype(np.int64)] = r["level"]
    scratch.drop(rows)
    return table


def prefixes(docs: DataFrame, table: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, n (set size), d1, d2 (digest of the set), g (digest of the prefix), prefix, sig (signature of the set)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for b in batches:
            data, off = texts(b)
            for i, j in spans(off, SLICE):
                h, o = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                key = levels[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | h >> np.uint64(6)
                key, o = sort_rows(key, o)
                n = np.diff(o)
                size = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                with np.errstate(over="ignore"):
                    odd = key * np.uint64(0x9E3779B97F4A7C15)
                    odd ^= odd >> np.uint64(31)
                    c1 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(odd, dtype=np.uint64)])
                    c2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(odd * odd ^ key, dtype=np.uint64)])
                    d1, d2, g = c1[o[1:]] - c1[o[:-1]], c2[o[1:]] - c2[o[:-1]], c1[o[:-1] + size] - c1[o[:-1]]
                sig = np.zeros((len(n), BITS // 64), np.uint64)
                np.bitwise_xor.at(sig, (np.repeat(np.arange(len(n)), n), (odd >> np.uint64(58)).astype(np.int64) % (BITS // 64)), np.uint64(1) << (odd >> np.uint64(20) & np.uint64(63)))
                sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (BITS // 64), pa.int32()), pa.array(sig.view(np.int64).ravel()))
                take = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
                flat = key[np.arange(take[-1]) + np.repeat(o[:-1] - take[:-1], size)].view(np.int64)
                pre = pa.ListArray.from_arrays(pa.array(take, pa.int32()), pa.array(flat))
                yield pa.record_batch(
                    [b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in (d1, d2, g)), pre, sigs],
                    ["doc_id", "n", "d1", "d2", "g", "prefix", "sig"],
                )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, g bigint, prefix array<bigint>, sig array<bigint>")


def shared_shingles(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(tok, gid, pos, n) for every prefix shingle that two groups or more have; pos: its place in the order."""
    n_parts = parts_for(groups.sparkSession, groups.agg(F.sum(F.size("prefix"))).first()[0] or 0)

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Slices(n_parts, give="hashes")
        for b in batches:
            pre = b.column(1)
            h = pre.flatten().to_numpy().view(np.uint64)
            size = pre.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            place = ranges(np.zeros(len(size), np.int64), size)
            # spread: the order key's leading bits are the level
            yield from s.add(b.column(0).to_numpy(), size, (h << np.uint64(6)) | (h >> np.uint64(58)), place)
        yield from s.flush()

    found = groups.select("gid", "prefix").mapInArrow(send, FOUND)

    def spread(own: np.ndarray, value: np.ndarray) -> pa.Table:
        return pa.table({"tok": pa.array((value >> np.uint64(16)).view(np.int64)), "gid": pa.array(own), "pos": pa.array((value & np.uint64(0xFFFF)).astype(np.int32))})

    # one Python function a stage: every further one would be another worker beside it
    pairs = repeated(found, n_parts, "hashes", then=spread, schema="tok bigint, gid bigint, pos int")
    out = scratch.keep(pairs.join(groups.select("gid", "n"), "gid"), "entries")
    return out


def verify(pairs: DataFrame, text: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v, shared, total) of the pairs (u, v) whose sets have 100 * shared >= percent * total; text: id, text.

    hub, one of the two, is the text that has many partners: it meets them in blocks.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = None, []  # the sets that the rows behind them meet: one, unless rows share a doc_id
        for b in batches:
            hub, part, partner = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            data, off = texts(b)
            for i, j in spans(off, SLICE):
                h, o = sort_rows(*shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k))
                rows = []
                for r, x in enumerate(partner.slice(i, j - i).to_pylist()):
                    p = h[o[r] : o[r + 1]]
                    if x is None:
                        if block != (hub[i + r], part[i + r]):
                            block, now = (hub[i + r], part[i + r]), []
                        now.append(p.copy())
                        continue
                    for q in now:
                        both = np.concatenate([p, q])
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                        if common and 100 * common >= percent * (len(both) - common):
                            rows.append((int(hub[i + r]), x, common, len(both) - common))
                if rows:
                    u, v, c, t = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                    yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(c), pa.array(t)], ["u", "v", "shared", "total"])

    pairs = pairs.select("hub", F.when(F.col("hub") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("other"))
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    pairs = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("other"), "n").alias("block"), "other")
    many = pairs.join(text.withColumnRenamed("id", "other").hint("merge"), "other").select("hub", "block", "other", "text")
    own = blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("block"))
    own = own.join(text.withColumnRenamed("id", "hub").hint("merge"), "hub").select("hub", "block", F.lit(None).cast("bigint").alias("other"), "text")
    both = many.union(own).repartition("hub", "block").sortWithinPartitions("hub", "block", F.asc_nulls_first("other"))
    return both.mapInArrow(run, "u bigint, v bigint, shared bigint, total bigint")


def _differ(a: str, b: str):
    """Bits in which two signatures differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, BITS // 64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _alike(n, m, differ, percent: int):
    """Whether sets of n and m shingles that differ in at least so many can still be alike: n + m - 2 * common may be at
    most (100 - percent) / (100 + percent) of n + m."""
    return (100 + percent) * differ <= (100 - percent) * (n + m)


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, hub) whose signatures don't rule out the threshold; sets: cid, n, sig."""
    a, b = (sets.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "uv")
    met = pairs.join(a, "u").join(b, "v")
    return met.where(_alike(F.col("nu"), F.col("nv"), _differ("su", "sv"), percent)).select("u", "v", "hub")


def _near(n, p, m, q, percent: int):
    """Whether sets of n and m shingles whose first common one stands at the places p and q can still be alike: at
    most min(n - p, m - q) are common, and percent / (100 + percent) of n + m must be."""
    return (100 + percent) * F.least(n - p, m - q) >= percent * (n + m)


def _band(percent: int):
    """Sets that are alike lie in one size band or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")


def _meet(entries: DataFrame, key, percent: int) -> DataFrame:
    """Distinct pairs of groups with a pivot of their shingle in their own or the next lower size band, and the pivot."""
    banded = entries.withColumn("band", _band(percent))
    pivot = banded.groupBy("tok", "band").agg(F.min(F.struct(key.alias("key"), "n", "gid", "pos", "comp")).alias("p"))
    pivot = pivot.select("tok", "band", *(F.col(f"p.{c}").alias(f"{c}_") for c in ("gid", "n", "pos", "comp")))
    probe = banded.select("tok", "gid", "n", "pos", "comp", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    met = probe.join(pivot, ["tok", "band"]).where((F.col("comp") != F.col("comp_")) & _near(F.col("n"), F.col("pos"), F.col("n_"), F.col("pos_"), percent))
    return met.groupBy(F.least("gid", "gid_").alias("u"), F.greatest("gid", "gid_").alias("v")).agg(F.min("gid_").alias("hub"))


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, star_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id: documents (rows) with the component that exact links give.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of k-word shingles (words of
    A-Z lower-cased; fewer than k words: the whole sequence). component_id is the smallest doc_id reachable by
    links, itself included; class_id the smallest doc_id with the same set. A null, empty or blank text has the
    empty set, which links with nothing, and stands alone. Rows with one doc_id are one node; a null doc_id stays
    out and gets null ids. Other columns are ignored; an empty table gives an empty one.
    """
    return _joined(docs, k, percent, star_rounds)[0]


def _joined(docs: DataFrame, k: int, percent: int, star_rounds: int) -> tuple[DataFrame, DataFrame]:
    """The rows of join, and the links (u, v) of classes that were verified: without star rounds all there are."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    table = order_table(docs, k, scratch)
    pre = scratch.keep(prefixes(docs, table, k, percent), "prefixes")
    live = pre.where("n > 0 and doc_id is not null")
    groups = scratch.keep(live.groupBy("n", "g").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix")), "groups")
    classes = live.groupBy("n", "g", "d1", "d2").agg(F.min("doc_id").alias("cid"), F.first("sig").alias("sig"))
    classes = scratch.keep(classes.join(groups.select("n", "g", "gid"), ["n", "g"]), "classes")
    docs_class = scratch.keep(pre.select("doc_id", "n", "g", "d1", "d2"), "docs")
    scratch.drop(pre)
    entries = shared_shingles(groups, scratch)
    scratch.drop(groups)
    several = classes.groupBy("gid").agg(F.count("*").alias("c")).where("c > 1").select("gid")
    active = scratch.keep(classes.join(entries.select("gid").union(several).distinct(), "gid", "left_semi").select("gid", "cid", "n", "sig"), "sets")
    text = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null")
    text = scratch.keep(text.join(active.select(F.col("cid").alias("id")).distinct(), "id"), "texts")
    links = comps = None
    seen = []
    for turn in range(star_rounds + 1):
        if comps is None:
            now = entries.withColumns({"comp": F.col("gid"), "most": F.col("gid")})
            label = active.withColumn("comp", F.col("cid"))
        else:
            at = comps.withColumnRenamed("node", "cid").withColumnRenamed("component", "comp")
            label = scratch.keep(active.join(at, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "labels")
            of_group = label.groupBy("gid").agg(F.min("comp").alias("comp"), F.max("comp").alias("most"))
            now = entries.join(of_group, "gid")
            open_ = now.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("most").alias("hi")).where("lo < hi").select("tok")
            now = scratch.keep(now.join(open_, "tok"), "rest")
        if turn < star_rounds:
            # representatives of groups; sets within a group meet its first set
            # the first pivot has the fewest rarer shingles: of near copies, the one closest to their origin
            key = F.col("pos").cast("bigint") if turn == 0 else F.xxhash64("gid", F.lit(turn))
            pairs = _meet(now, key, percent)
            if turn == 0:
                pairs = pairs.union(label.where("cid <> gid").select(F.col("gid").alias("u"), F.col("cid").alias("v"), F.col("gid").alias("hub")))
            pairs = plausible(pairs, active, percent)
        else:
            # every pair of sets of near size across components that share a shingle or a group, if places and signatures allow it
            sets = label.select("gid", "cid", F.col("comp").alias("c"), "sig")
            rows = now.select("tok", "gid", "pos", "n").join(sets, "gid").withColumn("band", _band(percent))
            a = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("a")
            b = rows.alias("b")
            one_way = (F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.cid") < F.col("b.cid"))
            near = _near(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), percent) & _alike(F.col("a.n"), F.col("b.n"), _differ("a.sig", "b.sig"), percent)
            met = a.join(b, (F.col("a.tok") == F.col("b.tok")) & (F.col("a.band") == F.col("b.band")) & one_way & (F.col("a.c") != F.col("b.c")) & near)
            wide = label.join(several, "gid", "left_semi")
            own = wide.alias("a").join(wide.alias("b"), (F.col("a.gid") == F.col("b.gid")) & (F.col("a.cid") < F.col("b.cid")) & (F.col("a.comp") != F.col("b.comp")) & _alike(F.col("a.n"), F.col("b.n"), _differ("a.sig", "b.sig"), percent))
            pairs = met.select("a.cid", "b.cid").union(own.select("a.cid", "b.cid")).toDF("x", "y")
            pairs = pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct().withColumn("hub", F.col("u"))
        for old in seen:
            pairs = pairs.join(old.select("u", "v"), ["u", "v"], "left_anti")
        pairs = scratch.keep(pairs, f"pairs{turn}")
        seen.append(pairs)
        if turn and pairs.isEmpty():
            continue
        new = links = scratch.keep(verify(pairs, text, k, percent).select("u", "v"), "links")
        if comps is not None:
            if new.isEmpty():
                continue
            new = new.union(comps.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")))
        comps = components(scratch, new)
        release(spark)
    at = comps.withColumnRenamed("node", "cid")
    labels = classes.drop("sig").join(at, "cid", "left").select("n", "g", "d1", "d2", "cid", F.coalesce("component", "cid").alias("component"))
    labels = scratch.keep(labels, "components")
    scratch.only(docs_class, labels, links)
    out = docs_class.join(labels, ["n", "g", "d1", "d2"], "left")
    alone = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    klass = F.when(F.col("n") > 0, F.col("cid")).otherwise(F.col("doc_id"))
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, alone).alias("component_id"), F.when(known, klass).alias("class_id")), links


def link_counts(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The columns of join and n_links: every candidate pair is verified, inside components too.

    n_links is the number of other doc_ids with a row whose set links with this row's set or equals it; 0 for the empty
    set, null for a null doc_id. Links are verified once a pair of different sets and counted by the documents that have
    them. Rows are told apart by a 64-bit hash of doc_id and text; equal rows are one.
    """
    scratch = Scratch(docs.sparkSession, "links")
    own = F.col("doc_id").cast("bigint")
    row = F.when(own.isNotNull(), F.xxhash64(own, "text"))
    found, links = _joined(docs.select(row.alias("doc_id"), "text"), k, percent, 0)
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("comp"), F.col("class_id").alias("class"))
    ids = docs.where("doc_id is not null").select(row.alias("row"), "doc_id").distinct()
    rows = scratch.keep(found.join(ids, "row", "left"), "rows")
    low = scratch.keep(rows.where("row is not null").groupBy("comp").agg(F.min("doc_id").alias("low")), "low")
    # rows of one doc_id join the components that they lie in
    nodes = components(scratch, rows.join(low, "comp").select(F.col("doc_id").cast("bigint").alias("u"), F.col("low").cast("bigint").alias("v")))
    classes = rows.where("row is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    member = scratch.keep(rows.where("row is not null and n_shingles > 0").select("class", "doc_id").distinct(), "members")
    # documents whose rows have several sets are counted apart, each once
    several = scratch.keep(member.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "several")
    size = member.join(several, "doc_id", "left_anti").groupBy("class").agg(F.count("*").alias("size"))
    near = links.union(links.select("v", "u")).union(member.select("class", "class").distinct()).toDF("class", "other")
    met = near.join(size.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("size").alias("once"))
    also = near.join(member.join(several, "doc_id").withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.countDistinct("doc_id").alias("also"))
    out = rows.join(classes, "class", "left").join(met, "class", "left").join(also, "class", "left").join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    n = F.when(F.col("n_shingles") > 0, F.coalesce("once", F.lit(0)) + F.coalesce("also", F.lit(0)) - 1).otherwise(F.lit(0)).cast("long")
    known = F.col("row").isNotNull()
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "class_id", F.when(known, n).alias("n_links"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return join(docs, k=4, percent=85).drop("class_id")


def query_links(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return link_counts(docs, k=4, percent=85)


#: The query's rows in DuckDB's SQL: every pair that shares a shingle is compared, then links are followed.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
c AS (SELECT u, least(u, min(v)) AS c FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.u = d.doc_id
"""
