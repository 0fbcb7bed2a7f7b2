"""Line dedup on content-defined chunks of lines, with DataFrame operations only.

A line's hash comes from its MD5; a rolling hash over each line and the one before it ends a chunk where it is
divisible by CUT, so inserting or deleting lines moves only the boundaries next to them. Chunks of two and more
lines that stand anywhere else are removed except for their first occurrence (lowest doc_id, then position),
after their bytes were compared with that occurrence. Single-line chunks always stay.

Chunk boundaries next to a passage's ends depend on the lines around it, so short passages mostly stay. With every=True each
run of LEAST lines is a key, wherever it starts: a line goes if it lies in a run that stands earlier, unless it lies in
the first occurrence of another repeated run. So every repeated run of LEAST and more lines is found, and still stands once.

Only keys and positions move while repeats are sought: counts and first occurrences are pre-aggregated in the map
tasks, and a chunk that stands in a third of all documents meets one row a key, in a join that AQE can split. The
texts are dealt by document once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: A chunk ends at one line in so many.
CUT = 3
#: Chunks with fewer lines are never removed.
LEAST = 2


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def let(value: Column, f) -> Column:
    """f of a value that is computed once: the optimizer moves projected expressions into lambdas, where they would be
    computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _ends(hashes: Column) -> Column:
    """Last lines of the chunks of a document with these line hashes."""
    last = F.size(hashes) - 1
    before = lambda i: F.when(i > 0, F.lit(31) * F.element_at(hashes, F.greatest(i, F.lit(1)))).otherwise(F.lit(0))
    return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(F.element_at(hashes, i + 1) + before(i), F.lit(CUT)) == 0))


def _keyed(lines: Column, least: int) -> Column:
    """Array of (start, n, key) of the chunks of at least so many lines."""

    def spans(ends: Column) -> Column:
        first = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))) + 1)
        return F.filter(F.transform(ends, lambda e, k: F.struct(first(k).alias("start"), (e - first(k) + 1).alias("n"))), lambda s: s["n"] >= least)

    def keys(ends: Column) -> Column:
        text = lambda s: _chunk_text(lines, s["start"], s["n"])
        return F.transform(spans(ends), lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), F.unhex(F.md5(text(s).cast("binary"))).alias("key")))

    return let(F.transform(lines, line_hash), lambda h: let(_ends(h), keys))


def _windows(lines: Column, size: int) -> Column:
    """Array of (start, n, key) of every run of so many lines."""
    text = lambda i: _chunk_text(lines, i, F.lit(size))
    starts = F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.greatest(F.size(lines) - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(size).alias("n"), F.unhex(F.md5(text(i).cast("binary"))).alias("key")))


def _lines_of(cuts: Column) -> Column:
    return F.flatten(F.transform(cuts, lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1)))


def _chunk_text(lines: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, n), "\n")


def dedup(docs: DataFrame, least: int = LEAST, every: bool = False) -> DataFrame:
    """The columns of docs, with repeated chunks (every: runs of lines) cut from text, and n_lines, n_removed (lines).

    Lines are what \\n separates. A null text stays null with 0 lines; an empty text is one empty line. All lines
    of a document may go, leaving the empty text; the row stays. Rows with equal doc_id and text are one document
    and fare alike; a null doc_id is the lowest. Extra columns pass through; n_lines and n_removed are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    # the caller's columns travel as one, so that none can clash with those made here
    rest = [F.col(f"`{c}`") for c in names if c != "text"]
    docs = docs.select(F.struct(*rest).alias("_row"), "doc_id", "text")
    lines = F.split("text", "\n", -1)
    cut = (
        docs.where("text is not null")
        # all that needs the text comes before the explosion, whose rows would each carry it
        .select("doc_id", F.md5(F.col("text").cast("binary")).alias("_dig"), let(lines, lambda x: _windows(x, least) if every else _keyed(x, least)).alias("_s"))
        .select("doc_id", "_dig", F.explode("_s").alias("s"))
        .select("doc_id", "_dig", "s.*")
        .distinct()
    )
    cut = scratch.keep(cut, "chunks")
    first = scratch.keep(
        cut.groupBy("key").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "_dig", "start")).alias("first")).where("times > 1").select("key", "first"),
        "first",
    )
    repeats = cut.join(first, "key").select(
        "doc_id", "_dig", F.struct("start", "n", "key", F.struct("doc_id", "_dig", "start").eqNullSafe(F.col("first")).alias("keeps")).alias("c")
    )
    by_doc = repeats.groupBy("doc_id", "_dig").agg(F.collect_list("c").alias("_found"))
    by_doc = scratch.keep(by_doc.withColumnRenamed("doc_id", "_id"), "found")
    full = docs.withColumn("_d", F.md5(F.col("text").cast("binary")))
    # by_doc grows with the corpus, so the plan is the same at every size: no broadcast
    full = scratch.keep(full.join(by_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_dig")), "left").drop("_id", "_dig"), "texts")
    # byte comparison of every repeat with the occurrence that stays
    shown = full.where("_found is not null")
    texts = let(lines, lambda x: F.transform("_found", lambda c: F.struct(c["key"].alias("key"), c["start"].alias("start"), c["keeps"].alias("keeps"), _chunk_text(x, c["start"], c["n"]).alias("_chunk"))))
    shown = shown.select("doc_id", "_d", texts.alias("_t")).select("doc_id", "_d", F.explode("_t").alias("c")).select("doc_id", "_d", "c.*")
    keeper = scratch.keep(shown.where("keeps").select("key", F.col("_chunk").alias("_kept")).dropDuplicates(["key"]), "kept")
    unlike = scratch.keep(
        shown.where("not keeps").join(keeper, "key").where("_chunk <> _kept").groupBy("doc_id", "_d").agg(F.collect_set("start").alias("_not")), "unlike"
    )
    if unlike.isEmpty():  # no two different chunks share a key
        full = full.withColumn("_not", F.lit(None).cast("array<int>"))
    else:
        unlike = unlike.select(F.col("doc_id").alias("_id"), F.col("_d").alias("_dig"), "_not")
        full = full.join(unlike, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_d").eqNullSafe(F.col("_dig")), "left").drop("_id", "_dig")
    gone = F.filter("_found", lambda c: ~c["keeps"] & ~F.coalesce(F.array_contains("_not", c["start"]), F.lit(False)))
    if every:  # runs overlap: single lines go, but none of a run that stands here first
        gone = F.array_except(_lines_of(gone), _lines_of(F.filter("_found", lambda c: c["keeps"])))
        gone = F.transform(gone, lambda i: F.struct(i.alias("start"), F.lit(1).alias("n")))
    full = full.withColumns({"_gone": F.array_sort(gone), "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")})
    hit = F.coalesce(F.size("_gone") > 0, F.lit(False))

    def rest_of(all_: Column, cuts: Column) -> Column:
        """The lines around the removed chunks, so that a text is put together in one pass."""
        n = F.size(cuts)

        def between(k: Column) -> Column:
            before, after = F.element_at(cuts, F.greatest(k, F.lit(1))), F.element_at(cuts, F.least(k + 1, n))
            lo = F.when(k == 0, F.lit(0)).otherwise(before["start"] + before["n"])
            return F.slice(all_, lo + 1, F.when(k == n, F.size(all_)).otherwise(after["start"]) - lo)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), between)), "\n")

    kept = let(lines, lambda x: let(F.col("_gone"), lambda g: rest_of(x, g)))
    cut_text = F.when(hit, kept).otherwise(F.col("text"))
    out = {c: cut_text if c == "text" else F.col(f"_row.`{c}`") for c in names}
    removed = F.when(hit, F.aggregate("_gone", F.lit(0), lambda a, c: a + c["n"])).otherwise(F.lit(0)).cast("long")
    return full.select(*(v.alias(c) for c, v in out.items()), "n_lines", removed.alias("n_removed"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def query_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup(docs, every=True).select("doc_id", "n_lines", "n_removed", "text")


#: The same rows in DuckDB's SQL.
ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, text, md5(text) AS dig, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, dig, unnest(lines) AS line, unnest(range(len(lines))) AS i, len(lines) AS n FROM d),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l),
e AS (SELECT *, i = n - 1 OR (h + 31 * coalesce(lag(h) OVER w, 0)) % {CUT} = 0 AS ends FROM h WINDOW w AS (PARTITION BY doc_id, dig ORDER BY i)),
g AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id, dig ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
k AS (SELECT doc_id, dig, c, min(i) AS start, string_agg(line, chr(10) ORDER BY i) AS chunk FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, dig, start) > 1 AS gone FROM k),
t AS (SELECT g.doc_id, g.dig, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(gone, false)), '') AS kept
  FROM g LEFT JOIN r ON g.doc_id = r.doc_id AND g.dig = r.dig AND g.c = r.c GROUP BY ALL)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN s.text IS NULL THEN NULL ELSE kept END AS text
FROM documents s LEFT JOIN t ON s.doc_id = t.doc_id AND md5(s.text) = t.dig
"""

#: The rows of query_passages in DuckDB's SQL.
ORACLE_PASSAGES = """
WITH d AS (SELECT DISTINCT doc_id, text, md5(text) AS dig, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, dig, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
w AS (SELECT *, line || chr(10) || lead(line) OVER (PARTITION BY doc_id, dig ORDER BY i) AS pair FROM l),
r AS (SELECT doc_id, dig, i, count(*) OVER (PARTITION BY pair) AS times, row_number() OVER (PARTITION BY pair ORDER BY doc_id, dig, i) AS k FROM w WHERE pair IS NOT NULL),
c AS (SELECT doc_id, dig, i + o.range AS i, NOT bool_or(k = 1) AS gone FROM r CROSS JOIN range(2) AS o WHERE times > 1 GROUP BY doc_id, dig, i + o.range),
t AS (SELECT l.doc_id, l.dig, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE NOT coalesce(gone, false)), '') AS kept
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.dig = c.dig AND l.i = c.i GROUP BY l.doc_id, l.dig)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN s.text IS NULL THEN NULL ELSE kept END AS text
FROM documents s LEFT JOIN t ON s.doc_id = t.doc_id AND md5(s.text) = t.dig
"""
