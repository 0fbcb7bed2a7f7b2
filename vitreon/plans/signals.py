"""Queries over series: the events of every user in order of time are a run; its value stands for each quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import constants as C
from ..operators import longruns as LR
from ..operators import moments as M
from ..operators import series as S
from ..streaming.jobs import folder

BY = ["run"]


def runs(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    t = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("run"), "event_type", "event_id", F.col("value").alias("y"), t.alias("t"))


E = "e AS (SELECT user_id AS run, event_type, event_id, value AS y, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS t FROM events)"


def running_mean(spark: SparkSession, d: str) -> DataFrame:
    return S.running_mean(runs(spark, d), BY, "t", "y", 5).select("run", "t", F.round("mean", 8).alias("mean"))


RUNNING = f"""WITH {E} SELECT run, t, CASE WHEN count(*) OVER w = 5 THEN round(avg(y) OVER w, 8) END AS mean FROM e WINDOW w AS (PARTITION BY run ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""


def trapezoid(spark: SparkSession, d: str) -> DataFrame:
    return S.cumulative_trapezoid(runs(spark, d), BY, "t", "y", F.lit(0.5)).select("run", "t", F.round("integral", 5).alias("integral"))


TRAPEZOID = f"""WITH {E}, s AS (SELECT *, coalesce((y + lag(y) OVER (PARTITION BY run ORDER BY t)) * 0.25, 0) AS s FROM e)
SELECT run, t, round(sum(s) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING), 5) AS integral FROM s"""


def sem(spark: SparkSession, d: str) -> DataFrame:
    return S.cumulative_sem(runs(spark, d), BY, "t", "y").select("run", "t", F.round("mean", 10).alias("mean"), F.round("sem", 8).alias("sem"))


SEM = f"""WITH {E} SELECT run, t, round(avg(y) OVER w, 10) AS mean, round(CASE WHEN count(*) OVER w > 1 THEN stddev_samp(y) OVER w / sqrt(count(*) OVER w) ELSE 0 END, 8) AS sem
FROM e WINDOW w AS (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING)"""


def acf(spark: SparkSession, d: str) -> DataFrame:
    c = LR.acf(runs(spark, d).withColumnRenamed("t", "_pos"), BY, "y")
    zero = F.first("acf").over(W.partitionBy("run").orderBy("lag").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return c.select("run", "lag", F.round(F.col("acf") / zero, 9).alias("acf"))


_ACF = f"""{E}, n AS (SELECT run, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT run, CAST(unnest(range(n)) AS INT) AS lag FROM n),
c AS (SELECT n.run, k.lag, sum(a.y * b.y) / any_value(n.n - k.lag) AS acf FROM n JOIN k ON k.run = n.run JOIN e AS a ON a.run = n.run JOIN e AS b ON b.run = a.run AND b.t = a.t + k.lag GROUP BY n.run, k.lag)"""
ACF = f"WITH {_ACF} SELECT c.run, c.lag, round(c.acf / z.acf, 9) AS acf FROM c JOIN c AS z ON z.run = c.run AND z.lag = 0"


def green_kubo(spark: SparkSession, d: str) -> DataFrame:
    c = LR.acf(runs(spark, d).withColumnRenamed("t", "_pos"), BY, "y")
    return S.cumulative_trapezoid(c, BY, "lag", "acf", F.lit(0.001)).select("run", "lag", F.round("integral", 6).alias("integral"))


GREEN_KUBO = f"""WITH {_ACF}, s AS (SELECT *, coalesce((acf + lag(acf) OVER (PARTITION BY run ORDER BY lag)) * 0.0005, 0) AS s FROM c)
SELECT run, lag, round(sum(s) OVER (PARTITION BY run ORDER BY lag ROWS UNBOUNDED PRECEDING), 6) AS integral FROM s"""


_SMALL = 1 << 10


def _one_run(spark: SparkSession, d: str) -> DataFrame:
    """All events as one run, numbered without a task that sees them all."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.lit("all").alias("run"), "ts", "event_id", F.col("value").alias("y"))
    return LR.placed(e, BY, ["ts", "event_id"])


def long_run(spark: SparkSession, d: str) -> DataFrame:
    """Running mean, trapezoid, mean and error of all events as one run, in blocks; means over pi, so that none lies between two roundings."""
    r = LR.running_mean(_one_run(spark, d), BY, "y", 101, "smooth", _SMALL)
    r = LR.cumulative_sem(LR.cumulative_trapezoid(r, BY, "y", F.lit(0.31830988618), "integral", _SMALL), BY, "y", _SMALL).withColumns({c: F.col(c) * 0.31830988618 for c in ("mean", "smooth")})
    return r.select(F.col("_pos").alias("t"), "event_id", F.round("smooth", 6).alias("smooth"), F.round("integral", 4).alias("integral"), F.round("mean", 7).alias("mean"), F.round("sem", 6).alias("sem"))


_ALL = "a AS (SELECT event_id, value AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS t FROM events)"
LONG_RUN = f"""WITH {_ALL}, s AS (SELECT *, coalesce((y + lag(y) OVER (ORDER BY t)) * 0.5 * 0.31830988618::DOUBLE, 0) AS s FROM a)
SELECT t, event_id, CASE WHEN count(*) OVER c = 101 THEN round(avg(y) OVER c * 0.31830988618::DOUBLE, 6) END AS smooth, round(sum(s) OVER w, 4) AS integral, round(avg(y) OVER w * 0.31830988618::DOUBLE, 7) AS mean, round(CASE WHEN count(*) OVER w > 1 THEN stddev_samp(y) OVER w / sqrt(count(*) OVER w) ELSE 0 END, 6) AS sem
FROM s WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING), c AS (ORDER BY t ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)"""


def long_acf(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelation of all events as one run at every lag, from pairs of blocks, over that at lag 0."""
    r = _one_run(spark, d)
    zero = r.groupBy("run").agg(F.avg(F.col("y") * F.col("y")).alias("zero"))
    n = spark.read.parquet(f"{d}/events.parquet").count()
    return LR.acf(r, BY, "y", block=LR.block_for(n, _SMALL)).join(zero, "run").select("lag", F.round(F.col("acf") / F.col("zero"), 6).alias("acf"))


LONG_ACF = f"WITH {_ALL} SELECT CAST(b.t - a.t AS INT) AS lag, round(sum(a.y * b.y) / count(*) / (SELECT avg(y * y) FROM a), 6) AS acf FROM a JOIN a AS b ON b.t >= a.t GROUP BY b.t - a.t"


def noise_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return S.noise_cutoff(runs(spark, d), BY, "t", "y", 0.5, 3)


NOISE = f"""WITH {E}, l AS (SELECT *, abs(y) < 0.5 * max(abs(y)) OVER (PARTITION BY run) AS low FROM e),
r AS (SELECT *, low AND coalesce(lead(low, 1) OVER w, false) AND coalesce(lead(low, 2) OVER w, false) AS run3 FROM l WINDOW w AS (PARTITION BY run ORDER BY t))
SELECT run, coalesce(min(t) FILTER (WHERE run3), min(t) FILTER (WHERE low), max(t)) AS cut FROM r GROUP BY ALL"""


def integral_cutoff(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    a = S.integral_cutoff(r, BY, "t", "y", F.lit(1.0), 0.1).withColumnRenamed("cut", "by_integral")
    b = S.self_consistent_cutoff(r.withColumn("y", F.exp(-F.col("t") / 4.0)), BY, "t", "y", F.lit(1.0)).withColumnRenamed("cut", "by_time")
    return a.join(b, "run").select("run", F.col("by_integral").cast("bigint"), F.col("by_time").cast("bigint"))


INTEGRAL = f"""WITH {E}, s AS (SELECT *, coalesce((y + lag(y) OVER w) * 0.5, 0) AS s, coalesce((exp(-t / 4.0) + lag(exp(-t / 4.0)) OVER w) * 0.5, 0) AS s2 FROM e WINDOW w AS (PARTITION BY run ORDER BY t)),
i AS (SELECT *, sum(s) OVER w AS i, sum(s2) OVER w AS i2 FROM s WINDOW w AS (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, i / nullif(arg_max(i, t) OVER (PARTITION BY run), 0) AS q, lag(i2) OVER (PARTITION BY run ORDER BY t) AS before FROM i),
g AS (SELECT *, abs(lead(q) OVER (PARTITION BY run ORDER BY t) - q) AS g FROM q)
SELECT run, CAST(least(coalesce(min(t) FILTER (WHERE q >= 0.9) + 1, min(t) FILTER (WHERE g < 0.1) + 2, max(t)), max(t)) AS BIGINT) AS by_integral,
CAST(coalesce(min(t) FILTER (WHERE before > 0 AND before < t / 5.0), max(t)) AS BIGINT) AS by_time FROM g GROUP BY ALL"""


def helfand(spark: SparkSession, d: str) -> DataFrame:
    """Mean square displacement of the running sum over lags up to half a run: 2 (C0 - C[lag])."""
    r = runs(spark, d)
    r = r.withColumn("chi", F.sum("y").over(W.partitionBy("run").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)))
    c = LR.acf(r.withColumnRenamed("t", "_pos"), BY, "chi")
    n = r.groupBy("run").agg(F.count("*").alias("n"))
    first = F.first("acf").over(W.partitionBy("run").orderBy("lag").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return c.select("run", "lag", (2 * (first - F.col("acf"))).alias("msd")).join(n, "run").where("lag > 0 and lag <= n div 2").select("run", "lag", F.round("msd", 2).alias("msd"))


HELFAND = f"""WITH {E}, x AS (SELECT run, t, sum(y) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING) AS y FROM e), n AS (SELECT run, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT run, CAST(unnest(range(n)) AS INT) AS lag FROM n),
c AS (SELECT n.run, k.lag, sum(a.y * b.y) / any_value(n.n - k.lag) AS acf FROM n JOIN k ON k.run = n.run JOIN x AS a ON a.run = n.run JOIN x AS b ON b.run = a.run AND b.t = a.t + k.lag GROUP BY n.run, k.lag)
SELECT c.run, c.lag, round(2 * (z.acf - c.acf), 2) AS msd FROM c JOIN c AS z ON z.run = c.run AND z.lag = 0 JOIN n ON n.run = c.run WHERE c.lag > 0 AND c.lag <= n.n // 2"""


def fluctuations(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).withColumns({"h": F.col("y") + F.col("t") * 0.01, "v": 1000.0 + F.col("y") * 0.1, "temp": F.lit(300.0)})
    a = S.expansion(r, BY, "h", ["v"], F.col("temp"))
    b = S.expansion_running(r, BY, "t", "h", "v", F.col("temp"), 5).withColumnRenamed("cte_v", "cte_running")
    return a.join(b, "run").select("run", F.round("cte_v", 6).alias("cte"), F.round("cte_running", 6).alias("cte_running"))


_KT = f"({C.K_B_EV!r} * 90000.0)"
FLUCT = f"""WITH {E}, r AS (SELECT *, y + t * 0.01 AS h, 1000.0 + y * 0.1 AS v FROM e), m AS (SELECT *, avg(h) OVER w AS mh, avg(v) OVER w AS mv, count(*) OVER w AS c FROM r WINDOW w AS (PARTITION BY run ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT a.run, round(a.x, 6) AS cte, round(b.x, 6) AS cte_running FROM (SELECT run, covar_pop(h, v) / (avg(v) * {_KT}) AS x FROM r GROUP BY run) AS a
JOIN (SELECT run, avg((h - mh) * (v - mv)) / (avg(v) * {_KT}) AS x FROM m WHERE c = 5 GROUP BY run) AS b ON a.run = b.run"""


def regression(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).withColumns({"temp": 300.0 + F.col("t"), "v": 1000.0 + F.col("y")})
    return S.expansion_fit(r, BY, "temp", "v").select("run", F.round("cte", 9).alias("cte"), F.round("r2", 9).alias("r2"))


REGRESSION = f"WITH {E} SELECT run, round(regr_slope(1000.0 + y, 300.0 + t) / arg_min(1000.0 + y, t), 9) AS cte, round(regr_r2(1000.0 + y, 300.0 + t), 9) AS r2 FROM e GROUP BY ALL"


_STAGE = 8


def incremental(spark: SparkSession, d: str) -> DataFrame:
    """Expansion by run from moment records: the rows come in three increments, each read once. A run's rows are at
    temperatures that rise every eight of them: by fluctuation within a temperature (the mean over these), and by the line
    through all rows."""
    r = runs(spark, d).withColumns({"temp": 300.0 + 10.0 * F.floor(F.col("t") / _STAGE), "v": 1000.0 + F.col("y") * 0.1, "h": F.col("y") + F.col("t") * 0.01})
    store = M.Increments(spark, folder(spark, "moments"), ["run", "stage"], ["temp", "h", "v"])
    r = r.withColumn("stage", F.col("temp"))
    for k in range(3):
        store.add(str(k), r.where(F.col("event_id") % 3 == k))
    found = store.now()
    one = M.fluctuation_expansion(found.where("n > 1"), "h", "v", F.col("mean_temp")).groupBy("run").agg(F.avg("cte").alias("by_fluctuation"), F.sum("n").alias("rows"))
    fit = M.fitted_expansion(found, ["run"], "temp", "v")
    return fit.join(one, "run").select("run", "rows", F.round("by_fluctuation", 6).alias("by_fluctuation"), F.round("cte", 9).alias("by_line"), F.round("r2", 7).alias("r2"))


INCREMENTAL = f"""WITH {E}, r AS (SELECT *, 300.0 + 10.0 * (t // {_STAGE}) AS temp, 1000.0 + y * 0.1 AS v, y + t * 0.01 AS h FROM e),
s AS (SELECT run, temp, count(*) AS n, avg(v) AS v, covar_pop(h, v) / (avg(v) * {C.K_B_EV!r} * temp * temp) AS cte FROM r GROUP BY run, temp),
a AS (SELECT run, avg(cte) AS f, sum(n) AS rows FROM s WHERE n > 1 GROUP BY run), l AS (SELECT run, arg_min(v, temp) AS low FROM s GROUP BY run),
b AS (SELECT run, regr_slope(v, temp) AS slope, regr_r2(v, temp) AS r2, count(DISTINCT temp) > 1 AS ok FROM r GROUP BY run)
SELECT run, CAST(rows AS BIGINT) AS rows, round(f, 6) AS by_fluctuation, CASE WHEN ok THEN round(slope / low, 9) END AS by_line, CASE WHEN ok THEN round(r2, 7) END AS r2 FROM a JOIN b USING (run) JOIN l USING (run)"""


def ensemble(spark: SparkSession, d: str) -> DataFrame:
    e = S.ensemble(runs(spark, d), ["event_type"], "y")
    return e.select("event_type", "n", *(F.round(c, 9).alias(c) for c in ("mean", "std", "sem")))


ENSEMBLE = "SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std, round(stddev_samp(value) / sqrt(count(*)), 9) AS sem FROM events GROUP BY ALL"


def convergence(spark: SparkSession, d: str) -> DataFrame:
    u = S.uncertain(runs(spark, d), BY, ["y"], 6.0, "v")
    return u.select("run", F.round("mean_y", 10).alias("mean"), F.round("sem_y", 6).alias("sem"), "converged")


CONVERGENCE = "SELECT user_id AS run, round(avg(value), 10) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem, count(*) > 1 AND stddev_samp(value) / sqrt(count(*)) < 6.0 AS converged FROM events GROUP BY ALL"


def plateau(spark: SparkSession, d: str) -> DataFrame:
    return S.plateaued(runs(spark, d), BY, "t", "y", 0.5, 0.01)


PLATEAU = f"""WITH {E}, n AS (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM e), s AS (SELECT * FROM n WHERE t >= floor(n * 0.5))
SELECT run, CASE WHEN count(*) < 2 THEN false WHEN avg(abs(y)) = 0 THEN true ELSE abs(regr_slope(y, t)) / avg(abs(y)) < 0.01 END AS plateaued FROM s GROUP BY ALL"""


def downsample(spark: SparkSession, d: str) -> DataFrame:
    return S.log_downsample(runs(spark, d).select("run", "t", "y"), BY, "t", 20)


DOWNSAMPLE = f"""WITH {E}, n AS (SELECT run, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT DISTINCT run, CAST(round_even(pow(10.0, log10(n) * range / 19) - 1, 0) AS INT) AS t FROM n CROSS JOIN range(20) WHERE n > 20)
SELECT e.run, e.t, e.y FROM e JOIN n ON e.run = n.run WHERE n <= 20 UNION ALL SELECT e.run, e.t, e.y FROM e JOIN k ON e.run = k.run AND e.t = k.t"""


def divisors(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 997 + 1).alias("target"), (F.col("event_id") % 50).alias("near")).distinct()
    return S.closest_divisor(df, "target", "near").select("target", "near", "divisor")


DIVISORS = """WITH x AS (SELECT DISTINCT event_id % 997 + 1 AS target, event_id % 50 AS near FROM events)
SELECT target, near, (SELECT arg_min(r.range, (abs(r.range - near), r.range)) FROM range(1, 998) AS r WHERE r.range <= target AND target % r.range = 0) AS divisor FROM x"""

def moduli(spark: SparkSession, d: str) -> DataFrame:
    """Of a matrix for every supplier: its deliveries by line number and part give the elements, above those of a stiff body."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    i, j = (F.col("l_linenumber") % 6 + 1).cast("int"), (F.col("l_partkey") % 6 + 1).cast("int")
    c = li.select(F.col("l_suppkey").alias("id"), i.alias("i"), j.alias("j"), F.col("l_quantity").cast("double").alias("q")).where("i <= 3 and j <= 3 or i = j")
    base = F.when((F.col("i") == F.col("j")) & (F.col("i") <= 3), 200.0).when(F.col("i") == F.col("j"), 60.0).otherwise(50.0)
    m = S.moduli(c.groupBy("id", "i", "j").agg(F.avg("q").alias("c")).withColumn("c", F.col("c") + base))
    return m.select("id", *(F.round(c, 8).alias(c) for c in ("bulk", "shear", "young", "poisson")))


MODULI = """WITH q AS (SELECT l_suppkey AS id, l_linenumber % 6 + 1 AS i, l_partkey % 6 + 1 AS j, avg(CAST(l_quantity AS DOUBLE)) AS q FROM lineitem GROUP BY ALL),
c AS (SELECT id, i, j, q + CASE WHEN i = j AND i <= 3 THEN 200.0 WHEN i = j THEN 60.0 ELSE 50.0 END AS c FROM q WHERE i <= 3 AND j <= 3 OR i = j),
a AS (SELECT id, avg(c) FILTER (WHERE i = j AND i <= 3) AS p, avg(c) FILTER (WHERE i <> j) AS q, avg(c) FILTER (WHERE i > 3) AS s FROM c GROUP BY ALL),
b AS (SELECT id, (p + 2 * q) / 3 AS bulk, ((p - q + 3 * s) / 5 + 5 * s * (p - q) / (4 * s + 3 * (p - q))) / 2 AS shear FROM a)
SELECT id, round(bulk, 8) AS bulk, round(shear, 8) AS shear, round(9 * bulk * shear / (3 * bulk + shear), 8) AS young, round((3 * bulk - 2 * shear) / (2 * (3 * bulk + shear)), 8) AS poisson FROM b"""


def stiffness(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).select((F.col("run") % 5).cast("string").alias("id"), (F.col("run") % 6 + 1).cast("int").alias("j"), F.when(F.floor(F.col("run") / 30) % 2 == 0, 1).otherwise(-1).alias("sign"), F.col("event_id").alias("step"), *((F.col("y") * k).alias(f"s{k}") for k in range(1, 7)))
    return S.stiffness(r, 0.001).select("id", "i", "j", F.round("c", 4).alias("c"))


STIFFNESS = """WITH r AS (SELECT CAST(user_id % 5 AS VARCHAR) AS id, CAST(user_id % 6 + 1 AS INT) AS j, CASE WHEN (user_id // 30) % 2 = 0 THEN 1 ELSE -1 END AS sign, event_id AS step, value AS y FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id, j, sign ORDER BY step) - 1 AS k, count(*) OVER (PARTITION BY id, j, sign) AS n FROM r),
m AS (SELECT id, j, (avg(y) FILTER (WHERE sign > 0) - avg(y) FILTER (WHERE sign < 0)) / 0.002 AS c FROM n WHERE k >= floor(n / 2.0) GROUP BY ALL)
SELECT id, CAST(i.range AS INT) AS i, j, round(c * i.range, 4) AS c FROM m CROSS JOIN range(1, 7) AS i WHERE (i.range <= 3 AND j <= 3) OR i.range = j"""


_A, _B, _T0 = "(-2.5 - id % 5 * 0.25)", "(4000.0 + id % 7 * 300)", "(350.0 + id % 11 * 15)"


def vft_fit(spark: SparkSession, d: str) -> DataFrame:
    """A curve for every supplier, through points at its parts' temperatures, which its quantities move off the law."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    p = li.select(F.col("l_suppkey").alias("id"), (800.0 + F.col("l_partkey") % 101 * 10).alias("t"), ((F.col("l_quantity").cast("double") - 25) * 0.002).alias("off"))
    pts = p.withColumn("l", F.expr(f"{_A} + {_B} / (t - {_T0}) + off"))
    f = S.fit_vft(pts.select("id", "t", "l"), ["id"], "t", "l")
    t4 = S.vft_inverse(F.lit(4.0), F.col("a"), F.col("b"), F.col("t0"))
    return f.select("id", F.round("a", 2).alias("a"), F.round("b", 0).alias("b"), F.round("t0", 1).alias("t0"), F.round(t4, 1).alias("t4"), F.round("rmse", 7).alias("rmse"))


# For a given t0 the law is a line in 1 / (t - t0); the best t0 is found by golden sections.
_GOLD = 0.6180339887498949
VFT_FIT = f"""WITH RECURSIVE p AS (SELECT l_suppkey AS id, 800.0 + l_partkey % 101 * 10 AS t, (CAST(l_quantity AS DOUBLE) - 25) * 0.002 AS off FROM lineitem),
q AS (SELECT id, t::DOUBLE AS t, {_A}::DOUBLE + {_B}::DOUBLE / (t - {_T0}::DOUBLE) + off AS l FROM p),
g AS (SELECT id, 0 AS k, 0.0::DOUBLE AS lo, min(t) - 1 AS hi FROM q GROUP BY id UNION ALL
  SELECT id, k + 1, CASE WHEN s1 <= s2 THEN lo ELSE x1 END, CASE WHEN s1 <= s2 THEN x2 ELSE hi END FROM (
    SELECT g.id, k, lo, hi, hi - {_GOLD} * (hi - lo) AS x1, lo + {_GOLD} * (hi - lo) AS x2, regr_syy(l, 1 / (t - (hi - {_GOLD} * (hi - lo)))) * (1 - regr_r2(l, 1 / (t - (hi - {_GOLD} * (hi - lo))))) AS s1,
      regr_syy(l, 1 / (t - (lo + {_GOLD} * (hi - lo)))) * (1 - regr_r2(l, 1 / (t - (lo + {_GOLD} * (hi - lo))))) AS s2
    FROM g JOIN q ON q.id = g.id WHERE k < 45 GROUP BY g.id, k, lo, hi)),
b AS (SELECT id, (lo + hi) / 2 AS t0 FROM g WHERE k = 45),
f AS (SELECT b.id, t0, regr_intercept(l, 1 / (t - t0)) AS a, regr_slope(l, 1 / (t - t0)) AS b FROM b JOIN q ON q.id = b.id GROUP BY b.id, t0)
SELECT f.id, round(any_value(a), 2) AS a, round(any_value(b), 0) AS b, round(any_value(t0), 1) AS t0, round(any_value(CASE WHEN a < 4 AND b > 0 THEN t0 + b / (4 - a) END), 1) AS t4, round(sqrt(avg(pow(a + b / (t - t0) - l, 2))), 7) AS rmse FROM f JOIN q ON q.id = f.id GROUP BY f.id"""


def vft_curve(spark: SparkSession, d: str) -> DataFrame:
    """The laws of the suppliers themselves, and two reference temperatures."""
    f = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id")).selectExpr("id", f"CAST({_A} AS DOUBLE) AS a", f"CAST({_B} AS DOUBLE) AS b", f"CAST({_T0} AS DOUBLE) AS t0")
    return S.vft_curve(S.reference_temperatures(f), 400.0, 1600.0, 50).select("id", "k", F.round("t", 6).alias("t"), F.round("log_eta", 6).alias("log_eta"), "t4", "t7_6")


VFT_CURVE = f"""WITH i AS (SELECT s_suppkey AS id FROM supplier), f AS (SELECT id, {_A}::DOUBLE AS a, {_B}::DOUBLE AS b, {_T0}::DOUBLE AS t0 FROM i), c AS (SELECT *, CAST(range AS INT) AS k, 400.0 + range * {1200.0 / 49!r} AS t FROM f CROSS JOIN range(50))
SELECT id, k, round(t, 6) AS t, round(a + b / (t - t0), 6) AS log_eta, round(t0 + b / (4.0 - a) - 273.15, 1) AS t4, round(t0 + b / (7.6 - a) - 273.15, 1) AS t7_6 FROM c WHERE t > t0 + 1"""


def viscosity(spark: SparkSession, d: str) -> DataFrame:
    """Green-Kubo and Helfand on the runs as stresses."""
    r = runs(spark, d).select(F.col("run").cast("string").alias("run_id"), F.col("t").cast("bigint").alias("step"), F.lit(3000.0).alias("temperature"), F.lit(8000.0).alias("volume"), ((F.col("y") % 7) - 3).alias("pxy"), ((F.col("y") % 5) - 2).alias("pxz"), ((F.col("y") % 3) - 1).alias("pyz"))
    a = S.viscosity(r, 1000.0).select("run_id", "viscosity")
    b = S.viscosity(r, 1000.0, "helfand").select("run_id", F.col("viscosity").alias("helfand"), "shear_modulus")
    return a.join(b, "run_id")


QUERIES = {
    "running_mean": running_mean, "trapezoid": trapezoid, "cumulative_sem": sem, "acf": acf, "green_kubo": green_kubo, "noise_cutoff": noise_cutoff, "integral_cutoff": integral_cutoff,
    "helfand_msd": helfand, "cte_fluctuations": fluctuations, "cte_regression": regression, "ensemble_stats": ensemble, "cte_convergence": convergence, "plateau": plateau,
    "log_downsample": downsample, "closest_divisor": divisors, "elastic_moduli": moduli, "stiffness": stiffness, "vft_fit": vft_fit, "vft_curve": vft_curve, "viscosity": viscosity, "cte_incremental": incremental,
    "long_run": long_run, "long_acf": long_acf,
}
ORACLES = {
    "running_mean": RUNNING, "trapezoid": TRAPEZOID, "cumulative_sem": SEM, "acf": ACF, "green_kubo": GREEN_KUBO, "noise_cutoff": NOISE, "integral_cutoff": INTEGRAL,
    "helfand_msd": HELFAND, "cte_fluctuations": FLUCT, "cte_regression": REGRESSION, "ensemble_stats": ENSEMBLE, "cte_convergence": CONVERGENCE, "plateau": PLATEAU,
    "log_downsample": DOWNSAMPLE, "closest_divisor": DIVISORS, "elastic_moduli": MODULI, "stiffness": STIFFNESS, "vft_fit": VFT_FIT, "vft_curve": VFT_CURVE, "cte_incremental": INCREMENTAL,
    "long_run": LONG_RUN, "long_acf": LONG_ACF,
}
