"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

The rates r_d that stay closest to 1 (in sum r log r - r) while each source's sum of r_d * size_d meets its token
target are r_d = min(2, exp(l_s * size_d / mean size of s)); l_s solves a one-dimensional convex dual. Distributed
Newton steps, guarded by a bracket, solve all sources together: each step is one aggregation over the histogram
(source, size), which map tasks pre-aggregate, so a source that holds a third of all rows is no larger there than
its distinct sizes. The sources themselves are a table too: their ranks, targets, tilts and brackets never leave it, however
many there are. The rates are then rounded into copies systematically along ascending size: of the documents
of one source, size and hash slice, the first so many by hash get one copy more. A source's total is thus off by
a part of its longest document; the phase of the rounding, one of PHASES, makes that part small. All cumulative
sums are integers, so reruns agree whatever the order of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, Scratch, release

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: All sources together take so many times all words.
SHARE = 1.5
#: No source, and no document, is taken more often than this.
MOST = 2
STEPS = 60
PHASES = 32
#: Slices of the documents of one source and size, so that a group of copies is ranked by many tasks.
SLICES = 512
#: Fractions of copies are counted in units of 2**-UNIT.
UNIT = 20
def word_count(text: Column) -> Column:
    """Number of maximal runs of non-blank characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources with rank: from 0 on in code point order, null last. Ranges are numbered side by side."""
    order = F.col("source").asc_nulls_last()
    placed = scratch.keep(sources.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "placed")
    before, offsets = 0, []
    for r in placed.groupBy("_p").count().orderBy("_p").collect():  # a row a partition
        offsets.append((r["_p"], before))
        before += r["count"]
    offset = F.broadcast(sources.sparkSession.createDataFrame(offsets, "_p int, _before long"))
    own = F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1
    return placed.join(offset, "_p").withColumn("rank", own + F.col("_before")).drop("_p", "_before")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources (words, rank) with target and full: in proportion to the weights, stopping at most * words; the excess is
    shared again by weight until none is above."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    t = sources.withColumn("_w", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
    top = F.lit(float(most)) * F.col("words")
    full, known, level = F.lit(False), -1, 0.0
    while True:
        # words and weights are whole numbers or nearly so: their sums don't depend on the order of tasks
        r = t.agg(F.sum("words").alias("all"), F.sum(F.when(full, F.col("words")).otherwise(0)).alias("taken"), F.sum(F.when(~full, F.col("_w"))).alias("free"), F.sum(full.cast("long")).alias("n")).first()
        if not r["free"] or r["n"] == known:
            break
        known, level = r["n"], (share * r["all"] - most * r["taken"]) / r["free"]
        full = F.lit(level) * F.col("_w") >= top
    return t.withColumn("full", full).withColumn("target", F.when(F.col("full"), top).otherwise(F.lit(level) * F.col("_w"))).drop("_w", "rank")


def _rate(l: Column, size: Column, mean: Column) -> Column:
    return F.least(F.exp(l * size / mean), F.lit(float(MOST)))


def _step(state: DataFrame, hist: DataFrame) -> DataFrame:
    """One guarded Newton step of every source that isn't done."""
    now = state.where("not done").select(F.col("source").alias("_s"), F.col("l").alias("_l"), F.col("mean").alias("_m"))
    rate, mass = _rate(F.col("_l"), F.col("size"), F.col("_m")), F.col("size") * F.col("n")
    got = (
        hist.join(now, F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("_s")
        .agg(F.sum(mass * rate).alias("_took"), F.sum(F.when(rate < MOST, mass * rate * F.col("size") / F.col("_m")).otherwise(0.0)).alias("_slope"))
    )
    s = state.join(got, F.col("source").eqNullSafe(F.col("_s")), "left")
    gap = F.col("_took") - F.col("target")
    s = s.withColumns({"_gap": gap, "done": F.col("done") | F.coalesce(F.abs(gap) <= 1e-8 * F.col("target"), F.lit(True))})
    s = s.withColumns({"lo": F.when(~F.col("done") & (F.col("_gap") <= 0), F.col("l")).otherwise(F.col("lo")), "hi": F.when(~F.col("done") & (F.col("_gap") > 0), F.col("l")).otherwise(F.col("hi"))})
    step = F.when(F.col("_slope") > 0, F.col("l") - F.col("_gap") / F.col("_slope"))
    # outside the bracket: double the tilt towards it, and halve what is left once that is possible
    low, high = F.greatest("lo", F.least(F.lit(-1.0), 2 * F.col("l") - 1)), F.least("hi", F.greatest(F.lit(1.0), 2 * F.col("l") + 1))
    other = F.when(low < high, (low + high) / 2).otherwise((F.col("lo") + F.col("hi")) / 2)
    new = F.when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise(other)
    return s.withColumn("l", F.when(F.col("done"), F.col("l")).otherwise(new)).select(state.columns)


def solve(hist: DataFrame, weights: tuple[float, ...], share: float, scratch: Scratch) -> DataFrame:
    """_s (source), source_size, target, _l (tilt), _m (mean size) of each source of hist (source, size, n)."""
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("_n"))
    goal = targets(scratch.keep(ranked(per, scratch), "sources"), weights, share, MOST)
    # a full source needs no equation, its documents all stand at the ceiling
    state = goal.select("source", "words", "target", F.greatest(F.lit(1.0), F.col("words") / F.col("_n")).alias("mean"), F.when(F.col("full"), 1e9).otherwise(0.0).alias("l"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.col("full").alias("done"))
    state = scratch.keep(state, "state")
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        old, state = state, scratch.keep(_step(state, hist), "state")
        scratch.drop(old)
    release(hist.sparkSession)
    return state.select(F.col("source").alias("_s"), F.col("words").alias("source_size"), "target", F.round("l", 9).alias("_l"), F.col("mean").alias("_m"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The columns of docs and size, source_size, target, rate, copies (0, 1 or 2) and taken = copies * size.

    A null or blank text has size 0, rate 0 and no copies; a null source is a source of its own, last in order;
    repeated rows are documents of their own; an empty table gives an empty one. Columns of docs that clash with
    the result's names are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs = docs.drop("size", "source_size", "target", "rate", "copies", "taken")
    names = docs.columns
    # the caller's columns travel as one, so that none can clash with those made here
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), "doc_id", "source", "text")
    named = docs.withColumns({
        "size": word_count(F.col("text")),
        "_slice": F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int"),
        "_h": F.xxhash64("doc_id", F.lit(1)),
        "_t": F.xxhash64("text"),  # tells rows of one doc_id apart
        # the source without null, so that join and window below share one exchange of the texts
        "_key": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
    }).drop("text")
    fine = scratch.keep(named.groupBy("source", "_key", "size", "_slice").agg(F.count("*").alias("n")), "fine")
    hist = scratch.keep(fine.groupBy("source", "size").agg(F.sum("n").alias("n")), "hist")
    plan = solve(hist, weights, share, scratch)
    rate = F.when(F.col("size") > 0, _rate(F.col("_l"), F.col("size"), F.col("_m"))).otherwise(0.0)
    whole = F.floor("rate").cast("int")
    part = F.floor((F.col("rate") - F.floor("rate")) * (1 << UNIT)).cast("long")
    along = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = scratch.keep(
        hist.join(plan, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("rate", rate)
        .withColumns({"_whole": whole, "_part": part})
        .withColumn("_end", F.sum(F.col("_part") * F.col("n")).over(along))
        .withColumn("_start", F.col("_end") - F.col("_part") * F.col("n"))
        .select("source", "size", "n", "source_size", "target", "rate", "_whole", "_part", "_start", "_end"),
        "steps",
    )

    def above(c: Column, phase: Column) -> Column:
        return F.shiftright(c + phase, UNIT)

    phases = [i * (1 << UNIT) // PHASES for i in range(PHASES)]
    off = [
        F.abs(F.sum(F.col("size") * (F.col("_whole") * F.col("n") + above(F.col("_end"), F.lit(p)) - above(F.col("_start"), F.lit(p)))) - F.first("target"))
        for p in phases
    ]
    tried = F.array(*(F.struct(o.alias("off"), F.lit(p).cast("long").alias("phase")) for o, p in zip(off, phases, strict=True)))
    phase = steps.groupBy("source").agg(F.array_min(tried)["phase"].alias("_phase")).withColumnRenamed("source", "_s")
    within = W.partitionBy("source", "size").orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    key = ["_key", "size", "_slice"]
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    share_of = (
        fine.alias("f")
        .join(steps.drop("n").alias("s"), same("f", "s", ["source", "size"]))
        .join(phase, F.col("f.source").eqNullSafe(F.col("_s")))
        .select("f.source", "f._key", "f.size", "_slice", "n", "source_size", "target", "rate", "_whole", "_part", "_start", "_phase")
        .withColumn("_to", F.col("_start") + F.sum(F.col("_part") * F.col("n")).over(within))
        .withColumn("_extra", above(F.col("_to"), F.col("_phase")) - above(F.col("_to") - F.col("_part") * F.col("n"), F.col("_phase")))
        .select(*key, "source_size", "target", "rate", "_whole", "_extra")
    )
    share_of = scratch.keep(share_of, "share")
    scratch.only(share_of)
    release(spark)
    places = W.partitionBy(*(F.col(f"d.{c}") for c in key)).orderBy("_h", "doc_id", "_t")
    out = (
        named.alias("d")
        .join(share_of.hint("merge").alias("p"), [F.col(f"d.{c}") == F.col(f"p.{c}") for c in key])
        .withColumn("copies", (F.col("_whole") + (F.row_number().over(places) <= F.col("_extra")).cast("int")).cast("int"))
    )
    return out.select(*(F.col(f"d._row.`{c}`").alias(c) for c in names), F.col("d.size"), "source_size", "target", "rate", "copies", (F.col("copies") * F.col("d.size")).cast("long").alias("taken"))


def copies(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: every row as often as its copies say."""
    return mixed.where("copies > 0").select("*", F.explode(F.array_repeat(F.lit(True), F.col("copies"))).alias("_copy")).drop("_copy")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
