"""A Merkle manifest of a dataset: a root, a proof for every row, and the check that finds rows that were changed.

Leaves are hashed in the scan that reads the texts; from then on only digests move. Each language's leaves are numbered
in order of their ids (a sort by ranges, whose counts give every range's first number) and cut into buckets of 2**BITS,
so that a bucket is a whole subtree. Executors hand a bucket, as an Arrow table, to DuckDB, which makes a level out of the
one below by sha256 over an ordered string_agg, and joins every leaf with its siblings. Spark then combines the roots of
the buckets in the same way, in groups of 2**UPPER and as many rounds as there have to be, and the roots of the languages
last; what these rounds leave of a proof is joined to the leaves of a bucket.

No task holds more than a bucket or a group, however many rows a language has; of a round's tables, each has 2**-UPPER
as many rows as the one before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, trim

#: Levels of the tree in a bucket of leaves, and in a group of roots.
BITS, UPPER = 14, 10
#: A row is tampered with where this divides the checksum of its id.
TAMPERED = 7
_STEPS = "array<struct<left:boolean,sib:binary>>"


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a row: lowercase hex SHA-256 of its fields, each a dash if null, else its length, a colon and its value."""
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf and seen (binary digests of the row as it was and as a checker meets it), row (a number of its own)."""
    d = docs.select("doc_id", "source", "lang", "n_chars", "text")
    odd = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    more = F.when(F.coalesce(odd, F.lit(False)), F.col("n_chars").cast("decimal(38,0)") + 1)
    there = [F.col(c) for c in ("doc_id", "source", "lang")]
    seen = F.when(more.isNotNull(), F.unhex(leaf(*there, more, F.col("text"))))
    return d.select("lang", "doc_id", F.unhex(leaf(*there, F.col("n_chars"), F.col("text"))).alias("leaf"), seen.alias("seen"), F.monotonically_increasing_id().alias("row"))


def numbered(scratch: Scratch, rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, their number from 0 on in the order of these columns in their group (nulls first), and n, the group's rows.

    order must tell all rows apart, so that no run of equal rows has to stay in one range.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = scratch.keep(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("_group").orderBy("_part")
    counts = counts.select("_group", "_part", "_first", F.coalesce(F.sum("_n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy("_group")).alias("n"))
    met = ranged.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part")))
    return met.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_group", "_part", "_first", "_before")


_engine = None


def _duckdb():
    """This worker's DuckDB, of one thread and bounded memory."""
    global _engine
    if _engine is None:
        import duckdb

        _engine = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False})
    return _engine


def levels(bucket: pa.Table, bits: int) -> pa.Table:
    """A bucket's leaves (pos, n, leaf and other columns) with steps, their siblings from the bottom up, and top, its root, beside the first.

    The tree has `bits` levels if the group has more leaves than a bucket, else as many as lead to one node.
    """
    con = _duckdb()
    n = bucket.column("n")[0].as_py()
    k = bits if n > 1 << bits else (len(bucket) - 1).bit_length()
    con.register("bucket", bucket)
    try:
        con.execute(f"CREATE OR REPLACE TEMP TABLE nodes AS SELECT 0 AS level, pos & {(1 << bits) - 1} AS pos, lower(hex(leaf)) AS h FROM bucket")
        for level in range(k):
            con.execute(f"INSERT INTO nodes SELECT {level + 1}, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE level = {level} GROUP BY pos // 2")
        return con.sql(f"""
            WITH ways AS (
                SELECT w.pos, list(struct_pack("left" := (w.place & 1) = 1, sib := coalesce(unhex(s.h), ''::BLOB)) ORDER BY w.level) AS steps
                FROM (SELECT pos, l AS level, pos >> l AS place FROM nodes, range({k}) AS r(l) WHERE nodes.level = 0) w
                LEFT JOIN nodes s ON s.level = w.level AND s.pos = xor(w.place, 1) GROUP BY w.pos
            ), top AS (SELECT unhex(h) AS h FROM nodes WHERE level = {k})
            SELECT b.lang, b.pos >> {bits} AS bucket, b.doc_id, b.leaf, coalesce(b.seen, b.leaf) AS seen, coalesce(ways.steps, []) AS steps,
                CASE WHEN b.pos & {(1 << bits) - 1} = 0 THEN (SELECT h FROM top) END AS top
            FROM bucket b LEFT JOIN ways ON ways.pos = b.pos & {(1 << bits) - 1}""").to_arrow_table()
    finally:
        con.unregister("bucket")
        con.execute("DROP TABLE IF EXISTS nodes")


def _hash(a: Column, b: Column) -> Column:
    """H of two digests, given and returned as binary."""
    return F.unhex(F.sha2(F.concat(F.lower(F.hex(a)), F.lower(F.hex(b))), 256))


def combine(scratch: Scratch, nodes: DataFrame, bits: int = UPPER) -> DataFrame:
    """key, node, steps (siblings from the node up to its key's root) and root, of nodes (key, node: numbers from 0 on, h).

    Nodes meet in groups of 2**bits, aligned, and the groups' roots again, until every key has one.
    """
    rounds = []
    while True:
        n = nodes.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"))
        packed = nodes.groupBy("key", F.shiftright("node", bits).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "h"))).alias("m"))
        packed = packed.join(n, F.col("key").eqNullSafe(F.col("_key"))).drop("_key")
        depth = F.when(F.col("n") > 1 << bits, F.lit(bits)).otherwise(F.when(F.size("m") > 1, F.length(F.bin(F.size("m") - 1))).otherwise(0))
        level = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda i: _hash(F.get(a, i * 2), F.coalesce(F.get(a, i * 2 + 1), F.lit(b""))))
        ups = F.when(F.col("depth") > 0, F.sequence(F.lit(1), F.col("depth"))).otherwise(F.array().cast("array<int>"))
        tree = F.aggregate(ups, F.array(F.transform("m", lambda x: x.h)), lambda acc, _: F.concat(acc, F.array(level(F.element_at(acc, -1)))))
        packed = packed.withColumn("depth", depth).withColumn("tree", tree).withColumn("h", F.get(F.element_at("tree", -1), F.lit(0)))
        packed = scratch.keep(packed.select("key", "up", "n", "m", "depth", "tree", "h"), "groups")
        each = packed.select("key", "up", "depth", "tree", F.posexplode("m").alias("p", "x"))
        ways = F.transform(
            F.when(F.col("depth") > 0, F.sequence(F.lit(0), F.col("depth") - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct((F.call_function("shiftright", F.col("p"), i) % 2 == 1).alias("left"), F.coalesce(F.get(F.get("tree", i), F.call_function("shiftright", F.col("p"), i).bitwiseXOR(F.lit(1))), F.lit(b"")).alias("sib")),
        )
        rounds.append(each.select("key", F.col("x.node").alias("node"), "up", ways.alias("steps")))
        nodes = packed.select("key", F.col("up").alias("node"), "h")
        if packed.where(F.col("n") > 1 << bits).isEmpty():
            break
    out = nodes.select("key", "node", F.array().cast(_STEPS).alias("steps"), F.col("h").alias("root"))
    for r in reversed(rounds):
        above = out.select(F.col("key").alias("_key"), F.col("node").alias("_node"), F.col("steps").alias("_steps"), "root")
        met = r.join(above, F.col("key").eqNullSafe(F.col("_key")) & (F.col("up") == F.col("_node")))
        out = scratch.keep(met.select("key", "node", F.concat("steps", "_steps").alias("steps"), "root"), "ways")
    return out


def manifest(docs: DataFrame, bits: int = BITS, upper: int = UPPER) -> DataFrame:
    """doc_id, leaf, subroot (of its language), root, proof_sha256 (of its siblings up to the root), folded_root (the root
    that the row, as a checker meets it, folds up to with these siblings) and verified (that this is the root).

    Rows of one language and doc_id are ordered by their leaves, equal rows are leaves of their own; null ids come first, and
    null languages form one of their own, the first. Any column may be null; texts of any length are hashed whole in the scan.
    Extra columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    hashed = scratch.keep(leaves(docs), "leaves")
    placed = numbered(scratch, hashed, "lang", ["doc_id", "leaf", "row"]).withColumn("bucket", F.shiftright("pos", bits))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(bucket: pa.Table) -> pa.Table:
        try:
            return levels(bucket, bits)
        finally:
            trim()

    inner = placed.groupBy("lang", "bucket").applyInArrow(run, f"lang string, bucket bigint, doc_id {kind}, leaf binary, seen binary, steps {_STEPS}, top binary")
    inner = scratch.keep(inner, "inner")
    scratch.drop(hashed)
    outer = combine(scratch, inner.where("top is not null").select(F.col("lang").alias("key"), F.col("bucket").alias("node"), F.col("top").alias("h")), upper)
    subroots = outer.where("node = 0").select(F.lit(0).alias("all"), F.col("key").alias("lang"), F.col("root").alias("h"))
    langs = numbered(scratch, subroots, "all", ["lang"])
    langs = scratch.keep(langs.select("all", "lang", F.col("pos").alias("at"), "h"), "langs")
    tops = combine(scratch, langs.select(F.col("all").alias("key"), F.col("at").alias("node"), "h"), upper)
    tops = tops.join(langs, F.col("node") == F.col("at")).select("lang", F.col("h").alias("subroot"), F.col("steps").alias("_steps"), "root")
    ways = outer.select("key", "node", "steps").join(tops, F.col("key").eqNullSafe(F.col("lang")))
    ways = ways.select(F.col("key").alias("_lang"), F.col("node").alias("_bucket"), F.concat("steps", "_steps").alias("_steps"), "subroot", "root")
    met = inner.join(ways, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("bucket") == F.col("_bucket")))
    met = met.withColumn("steps", F.concat("steps", "_steps"))
    folded = F.aggregate("steps", F.col("seen"), lambda acc, s: F.when(s.left, _hash(s.sib, acc)).otherwise(_hash(acc, s.sib)))
    text = lambda c: F.lower(F.hex(c))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.lower(F.hex(s.sib))), ""), 256)
    met = met.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), proof.alias("proof_sha256"), text(folded).alias("folded_root"))
    return met.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return manifest(docs)


#: The checksum of a short text, digit by digit and bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""


def _sql_field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


ORACLE = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, {_sql_leaf("(n_chars + 1)")} AS other, coalesce({_CRC} % {TAMPERED} = 0, false) AS odd FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, CASE WHEN odd THEN other ELSE leaf END AS seen FROM hashed
), nodes AS (
    SELECT lang, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
    UNION ALL
    SELECT lang, max(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, pos // 2
), subroots AS (
    SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS level, pos, h, n FROM subroots
    UNION ALL
    SELECT max(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY pos // 2
), heights AS (
    SELECT DISTINCT lang, level, true AS inside FROM nodes WHERE n > 1 UNION ALL SELECT DISTINCT s.lang, 1000 + t.level, false FROM subroots s, tops t WHERE t.n > 1
), ways AS (
    SELECT p.lang, p.pos, h.level, h.inside, CASE WHEN h.inside THEN p.pos ELSE s.pos END >> (h.level % 1000) AS place
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN heights h ON h.lang IS NOT DISTINCT FROM p.lang
), steps AS (
    SELECT w.lang, w.pos, list(CASE WHEN place % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(a.h, b.h, '') ORDER BY w.level) AS steps
    FROM ways w LEFT JOIN nodes a ON w.inside AND a.lang IS NOT DISTINCT FROM w.lang AND a.level = w.level AND a.pos = xor(w.place, 1)
    LEFT JOIN tops b ON NOT w.inside AND b.level = w.level - 1000 AND b.pos = xor(w.place, 1) GROUP BY w.lang, w.pos
), folded AS (
    SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root,
        sha256(array_to_string(list_transform(coalesce(steps, []), lambda x: x[2:]), '')) AS proof_sha256,
        list_reduce(list_concat([p.seen], coalesce(steps, [])), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN steps t ON t.lang IS NOT DISTINCT FROM p.lang AND t.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM folded"""
