"""Queries over job tables: orders are jobs, events their steps, vectors their compositions; and streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import jobs as J
from ..operators import nearest
from ..streaming import correlator, lifecycle
from ..streaming import jobs as streams


def jobs(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("pending")
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("request_hash"), F.col("o_orderpriority").alias("composition"), status.alias("status"),
        F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("result_data"), F.col("o_orderdate").alias("created_at"),
    )


def steps(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    s = F.when(F.col("value") < 10, "pending").when(F.col("value") < 40, "running").when(F.col("value") < 120, "completed").otherwise("failed")
    return e.select("event_id", "ts", F.col("user_id").alias("job_id"), F.col("event_type").alias("step"), s.alias("status"), F.when(s == "failed", F.lit("error")).alias("error"), "value")


JOBS = """j AS (SELECT o_orderkey AS job_id, o_custkey AS request_hash, o_orderpriority AS composition, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
  CASE WHEN o_totalprice > 1000 THEN o_totalprice END AS result_data, o_orderdate AS created_at FROM orders)"""
STEPS = """s AS (SELECT event_id, ts, user_id AS job_id, event_type AS step, CASE WHEN value < 10 THEN 'pending' WHEN value < 40 THEN 'running' WHEN value < 120 THEN 'completed' ELSE 'failed' END AS status, value FROM events)"""
LAST = f"{STEPS}, l AS (SELECT *, row_number() OVER (PARTITION BY job_id, step ORDER BY ts DESC, event_id DESC) AS r FROM s)"


def latest(spark: SparkSession, d: str) -> DataFrame:
    return J.latest(jobs(spark, d), ["request_hash"], [F.col("created_at"), F.col("job_id")]).select("request_hash", "job_id", "status")


LATEST = f"WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY request_hash ORDER BY created_at DESC, job_id DESC) AS r FROM j) SELECT request_hash, job_id, status FROM r WHERE r = 1"


def hits(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("request_hash"))
    return J.cache_hits(asked, jobs(spark, d)).select("request_hash", F.coalesce("job_id", F.lit(-1).cast("bigint")).alias("job_id"))


HITS = f"""WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY request_hash ORDER BY created_at DESC, job_id DESC) AS r FROM j WHERE status = 'completed' AND result_data IS NOT NULL)
SELECT c_custkey AS request_hash, coalesce(r.job_id, -1) AS job_id FROM customer LEFT JOIN r ON r.request_hash = c_custkey AND r.r = 1"""


def listing(spark: SparkSession, d: str) -> DataFrame:
    return J.composition_counts(jobs(spark, d))


LISTING = f"WITH {JOBS} SELECT composition, count(*) AS n_jobs FROM j WHERE status = 'completed' GROUP BY ALL"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("job_id"), F.col("embedding").cast("array<double>").alias("elemental_vector"), F.col("label"))


def topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to an even one, but for label 3."""
    v = _vectors(spark, d)
    near = J.close_matches([0.125] * 64, v, v.where("label = 3"), 10.0, 10)
    return near.select("job_id", F.round("distance", 4).alias("distance"), "similarity")


TOPK = """SELECT vec_id AS job_id, round(list_distance(CAST(embedding AS DOUBLE[]), list_resize([]::DOUBLE[], 64, 0.125)), 4) AS distance,
round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), list_resize([]::DOUBLE[], 64, 0.125))), 4) AS similarity FROM embeddings WHERE label <> 3
ORDER BY list_distance(CAST(embedding AS DOUBLE[]), list_resize([]::DOUBLE[], 64, 0.125)), vec_id LIMIT 10"""


def vector_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id 20 divides, the five nearest others."""
    v = _vectors(spark, d).select(F.col("job_id").alias("id"), F.col("elemental_vector").alias("vector"))
    got = nearest.nearest(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), v, 5)
    return got.select("query_id", "rank", "id", F.round("distance", 7).alias("distance"))


VECTOR_NEAREST = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT q.id AS query_id, v.id, list_distance(q.v, v.v) AS d FROM v AS q JOIN v ON v.id <> q.id WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d) SELECT query_id, CAST(rank AS INT) AS rank, id, round(d, 7) AS distance FROM r WHERE rank <= 5"""


def request_documents(spark: SparkSession, d: str) -> DataFrame:
    """Requests as JSON of every customer's orders, some of them broken or nested in a string: their analyses, and the numbers
    of the first of a kind and of a structure."""
    c, o = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    one = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.substring("o_orderpriority", 1, 1).alias("type")))).alias("l"))
    item = lambda x: F.concat(F.lit('{"type":"t'), x["type"], F.lit('","steps":'), x["k"].cast("string"), F.lit("}"))
    body = F.concat(F.lit('{"analyses":['), F.array_join(F.transform(F.coalesce("l", F.array().cast(one.schema["l"].dataType)), item), ","), F.lit('],"structure":'))
    numbers = F.concat(F.lit('{"numbers":['), "c_custkey", F.lit(","), "c_nationkey", F.lit("]}"))
    k = F.col("c_custkey") % 4
    inner = F.when(k == 0, F.concat(F.lit('"'), F.replace(numbers, F.lit('"'), F.lit('\\"')), F.lit('"'))).when(k == 1, numbers).otherwise(F.lit("null"))
    docs = c.join(one, "c_custkey", "left").select("c_custkey", F.when(k == 3, F.substring(body, 1, 20)).otherwise(F.concat(body, inner, F.lit("}"))).alias("request"))
    got = J.documents(docs, "request")
    return got.select("c_custkey", F.concat_ws(",", "analyses").alias("analyses"), J.first_parameter(F.col("v"), "t1", "steps", "bigint").alias("steps"), F.element_at(F.col("numbers"), 1).cast("bigint").alias("number"), F.col("v").isNull().alias("broken"))


REQUEST_DOCUMENTS = """WITH l AS (SELECT o_custkey AS c_custkey, o_orderkey AS k, 't' || substr(o_orderpriority, 1, 1) AS type FROM orders),
a AS (SELECT c_custkey, string_agg(type, ',' ORDER BY k) AS analyses, min(k) FILTER (WHERE type = 't1') AS steps FROM l GROUP BY ALL)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE coalesce(analyses, '') END AS analyses, CASE WHEN c_custkey % 4 <> 3 THEN steps END AS steps, CASE WHEN c_custkey % 4 < 2 THEN c_custkey END AS number, c_custkey % 4 = 3 AS broken FROM customer LEFT JOIN a USING (c_custkey)"""


def tags(spark: SparkSession, d: str) -> DataFrame:
    """Users whose event types hold purchase and error, with all their types as sorted tags."""
    t = steps(spark, d).groupBy("job_id").agg(J.merged_tags(F.collect_set("step"), F.lit(None).cast("array<string>")).alias("tags"))
    return t.where(F.size(J.missing(F.col("tags"), ["purchase", "error"])) == 0).select("job_id", F.concat_ws(",", "tags").alias("tags"))


TAGS = f"WITH {STEPS} SELECT job_id, string_agg(DISTINCT step, ',' ORDER BY step) AS tags FROM s GROUP BY job_id HAVING bool_or(step = 'purchase') AND bool_or(step = 'error')"


def missing(spark: SparkSession, d: str) -> DataFrame:
    wanted = ["click", "error", "purchase", "refund", "signup", "view"]
    t = steps(spark, d).where("status = 'completed'").groupBy("job_id").agg(F.collect_set("step").alias("p"))
    return t.select("job_id", F.concat_ws(",", J.missing(F.col("p"), wanted)).alias("missing"))


MISSING = f"""WITH {STEPS}, c AS (SELECT DISTINCT job_id, step FROM s WHERE status = 'completed'), w AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS step)
SELECT x.job_id, coalesce(string_agg(w.step, ',' ORDER BY w.step) FILTER (WHERE c.step IS NULL), '') AS missing FROM (SELECT DISTINCT job_id FROM c) AS x CROSS JOIN w LEFT JOIN c ON c.job_id = x.job_id AND c.step = w.step GROUP BY ALL"""


def step_status(spark: SparkSession, d: str) -> DataFrame:
    return J.step_status(steps(spark, d), "signup").select("job_id", "step", "status")


STEP_STATUS = f"""WITH {LAST}, b AS (SELECT DISTINCT job_id FROM l WHERE r = 1 AND step = 'signup' AND status = 'completed')
SELECT l.job_id, step, CASE WHEN step = 'signup' OR b.job_id IS NOT NULL THEN status ELSE 'pending' END AS status FROM l LEFT JOIN b ON b.job_id = l.job_id WHERE r = 1"""


def status(spark: SparkSession, d: str) -> DataFrame:
    return J.job_status(J.step_status(steps(spark, d), "signup"))


STATUS = f"""WITH x AS ({STEP_STATUS}) SELECT job_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status IN ('running', 'completed')) THEN 'running' ELSE 'pending' END AS status FROM x GROUP BY ALL"""


def timings(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).select("job_id", (F.col("value") - 5).alias("seconds"), (F.col("event_id") % 8 + 1).alias("cores"))
    return J.timings(s).select("job_id", F.round("seconds", 6).alias("seconds"), F.round("core_hours", 8).alias("core_hours"))


TIMINGS = "SELECT user_id AS job_id, round(sum(value - 5), 6) AS seconds, round(sum((value - 5) * (event_id % 8 + 1)) / 3600, 8) AS core_hours FROM events WHERE value - 5 > 0 GROUP BY ALL"


def hashes(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", J.request_hash({"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")}).alias("hash"))


HASHES = """SELECT c_custkey, substr(sha256('{"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}'), 1, 16) AS hash FROM customer"""


def merged(spark: SparkSession, d: str) -> DataFrame:
    """Value per type of each user: the first of all, overridden by the last of purchases and errors."""
    s = steps(spark, d)
    m = lambda df, f: df.groupBy("job_id", "step").agg(f("event_id", F.struct("ts", "event_id")).alias("v")).groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("step", "v"))).alias("m"))
    a, b = m(s, F.min_by), m(s.where("step in ('purchase', 'error')"), F.max_by).withColumnRenamed("m", "m2")
    out = a.join(b, "job_id", "left").select("job_id", F.explode(J.merged_results(F.col("m"), F.coalesce("m2", F.create_map().cast("map<string,bigint>")))).alias("step", "event_id"))
    return out


MERGED = f"""WITH {STEPS} SELECT job_id, step, CASE WHEN step IN ('purchase', 'error') THEN arg_max(event_id, (ts, event_id)) ELSE arg_min(event_id, (ts, event_id)) END AS event_id FROM s GROUP BY job_id, step"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # a pattern, since a stream's path may not be a file, and the table may be one or a folder of them
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(df: DataFrame, name: str, mode: str) -> DataFrame:
    return streams.drained(df, streams.folder(df.sparkSession, name), mode)


def stream_status(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    s = F.when(F.col("value") < 10, "pending").when(F.col("value") < 40, "running").when(F.col("value") < 120, "completed").otherwise("failed")
    e = e.select("event_id", "ts", F.col("user_id").alias("job_id"), F.col("event_type").alias("step"), s.alias("status"))
    return _drained(streams.latest_status(e), "stream_step_status", "complete").select("job_id", "step", "status")


STREAM_STATUS = f"WITH {LAST} SELECT job_id, step, status FROM l WHERE r = 1"


_LATE = "event_id % 20 = 0"


def _thirds(spark: SparkSession, d: str) -> list[DataFrame]:
    """The events in three batches by thirds of the time; some of the first two are held back to the third."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    upto = lambda k: (F.col("ts") <= F.lit(ends.lo + (ends.hi - ends.lo) * k / 3)) & ~F.expr(_LATE)
    return [e.where(part) for part in (upto(1), upto(2) & ~upto(1), ~upto(2))]


def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    """Days that the watermark has closed. What is held back is too late to count where the first two batches have closed its day."""
    build = lambda e: streams.rates(e.select("ts", F.col("event_type").alias("step"), "value"))
    r = streams.in_turn(_thirds(spark, d), build, streams.folder(spark, "stream_rates"), "append")
    return r.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "step", "n", F.round("mean_value", 8).alias("mean_value"))


_MARKS = f"""b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), m AS (SELECT *, {" , ".join(f"epoch_us(ts) <= lo + CAST(round_even((hi - lo) * {k} / 3, 0) AS BIGINT) AND NOT {_LATE} AS {name}" for k, name in ((1, "first"), (2, "early")))} FROM events CROSS JOIN b),
w AS (SELECT max(ts) FILTER (WHERE early) - INTERVAL 1 HOUR AS mark, max(ts) - INTERVAL 1 HOUR AS last FROM m)"""
STREAM_RATES = f"""WITH {_MARKS}, k AS (SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY AS ends FROM m CROSS JOIN w)
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS step, count(*) AS n, round(avg(value), 8) AS mean_value FROM k WHERE (early OR ends > mark) AND ends <= last GROUP BY ALL"""


_LIMIT = "4 days"


def stream_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """How the jobs (a user's events of one type) ended or stand: a time limit of four days, and no way back from an end."""
    lifecycle.use_rocksdb(spark)
    s = F.when(F.col("value") < 20, "pending").when(F.col("value") < 110, "running").when(F.col("value") < 160, "completed").otherwise("failed")
    build = lambda e: lifecycle.lifecycles(e.select(F.concat_ws("/", "user_id", "event_type").alias("job_id"), "ts", "event_id", s.alias("status")), _LIMIT, "90 days")
    r = streams.in_turn(_thirds(spark, d), build, streams.folder(spark, "stream_lifecycle"), "update")
    # a later batch's row, and of one batch the end, is the last word
    return J.latest(r, ["job_id"], [F.col("batch"), F.col("ended_us")]).select("job_id", "status", "last_us", "ended_us")


STREAM_LIFECYCLE = f"""WITH {_MARKS}, a AS (SELECT user_id || '/' || event_type AS job_id, epoch_us(ts) AS t, event_id, CASE WHEN value < 20 THEN 'pending' WHEN value < 110 THEN 'running' WHEN value < 160 THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN first THEN 1 WHEN early THEN 2 ELSE 3 END AS batch, last FROM m CROSS JOIN w WHERE early OR ts > mark),
o AS (SELECT *, max(t) OVER (PARTITION BY job_id ORDER BY batch, t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
g AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY batch, t, event_id) AS k FROM o WHERE before IS NULL OR t >= before),
e AS (SELECT *, t - lag(t) OVER (PARTITION BY job_id ORDER BY k) > epoch_us(INTERVAL {_LIMIT}) AS gap, lag(t) OVER (PARTITION BY job_id ORDER BY k) AS p FROM g),
f AS (SELECT job_id, min(k) AS stop FROM e WHERE coalesce(gap, false) OR status IN ('completed', 'failed') GROUP BY ALL),
x AS (SELECT e.*, stop FROM e LEFT JOIN f USING (job_id) WHERE stop IS NULL OR k <= stop),
z AS (SELECT job_id, arg_max(coalesce(gap, false), k) AS gap, arg_max(status, k) AS s, arg_max(t, k) AS t, arg_max(p, k) AS p, any_value(stop) AS stop, bool_or(status = 'running') AS ran, any_value(epoch_us(last)) AS last FROM x GROUP BY job_id)
SELECT job_id, CASE WHEN stop IS NULL THEN CASE WHEN t + epoch_us(INTERVAL {_LIMIT}) < last THEN 'timed_out' WHEN ran THEN 'running' ELSE 'pending' END WHEN gap THEN 'timed_out' ELSE s END AS status,
CASE WHEN gap AND stop IS NOT NULL THEN p ELSE t END AS last_us,
CASE WHEN stop IS NULL THEN CASE WHEN t + epoch_us(INTERVAL {_LIMIT}) < last THEN t + epoch_us(INTERVAL {_LIMIT}) END WHEN gap THEN p + epoch_us(INTERVAL {_LIMIT}) ELSE t END AS ended_us FROM z"""


_TAU = {"p": 8, "levels": 5, "every": 16, "tolerance": 0.4, "stable": 2}


def stream_viscosity(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose stresses come in three batches, extended until their viscosity has settled."""
    lifecycle.use_rocksdb(spark)
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("step", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.select(F.col("user_id").cast("string").alias("run_id"), "step", "event_id", *(((F.col("value") % k) - k // 2).alias(c) for k, c in ((7, "pxy"), (5, "pxz"), (3, "pyz"))))
    lo, hi = e.agg(F.min("step"), F.max("step")).first()
    cut = [lo + (hi - lo) // 3, lo + 2 * ((hi - lo) // 3)]
    parts = [e.where(F.col("step") <= cut[0]), e.where((F.col("step") > cut[0]) & (F.col("step") <= cut[1])), e.where(F.col("step") > cut[1])]
    build = lambda s: correlator.viscosities(s, ["pxy", "pxz", "pyz"], 1000.0, 8000.0, 3000.0, **_TAU, order=("step", "event_id"))
    r = streams.in_turn(parts, build, streams.folder(spark, "stream_viscosity"), "update")
    return J.latest(r, ["run_id"], [F.col("batch")]).select("run_id", "n", F.round(F.col("viscosity") * 1e6, 2).alias("viscosity_upas"), "done")


_SCALE = 8000.0 * 1e-30 / (C.K_B_J * 3000.0) * 1e18 * 1000.0 * 1e-15 * 1e6
STREAM_VISCOSITY = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, [value % 7 - 3, value % 5 - 2, value % 3 - 1] AS x FROM events),
n AS (SELECT run_id, count(*) AS n FROM e GROUP BY ALL), b AS (SELECT run_id, l.range AS l, t // (1 << l.range) AS b, avg(x[1]) AS x1, avg(x[2]) AS x2, avg(x[3]) AS x3 FROM e, range({_TAU['levels']}) AS l GROUP BY ALL HAVING count(*) = 1 << any_value(l.range)),
c AS (SELECT run_id, m, m % {_TAU['every']} = 0 AS checked FROM (SELECT run_id, unnest(range({_TAU['every']}, n + 1, {_TAU['every']})) AS m FROM n UNION SELECT run_id, n FROM n)),
p AS (SELECT i.run_id, i.l, j.b - i.b AS k, (j.b + 1) << i.l AS done_at, (i.x1 * j.x1 + i.x2 * j.x2 + i.x3 * j.x3) / 3 AS y FROM b AS i JOIN b AS j ON i.run_id = j.run_id AND i.l = j.l AND j.b BETWEEN i.b AND i.b + {_TAU['p'] - 1} WHERE i.l = 0 OR j.b - i.b >= {_TAU['p'] // 2}),
a AS (SELECT c.run_id, m, checked, k << l AS lag, avg(y) AS y FROM c JOIN p ON p.run_id = c.run_id AND done_at <= m GROUP BY ALL),
s AS (SELECT run_id, m, checked, coalesce((y + lag(y) OVER w) / 2 * (lag - lag(lag) OVER w), 0) AS s FROM a WINDOW w AS (PARTITION BY run_id, m ORDER BY lag)),
v AS (SELECT run_id, m, checked, sum(s) * {_SCALE!r} AS eta FROM s GROUP BY ALL), q AS (SELECT *, checked AND abs(eta - lag(eta) OVER (PARTITION BY run_id ORDER BY m)) < {_TAU['tolerance']} * abs(eta) AS calm FROM v),
r AS (SELECT *, coalesce(calm, false) AND coalesce(lag(calm) OVER (PARTITION BY run_id ORDER BY m), false) AS done FROM q), z AS (SELECT run_id, coalesce(min(m) FILTER (WHERE done), max(m)) AS m FROM r GROUP BY ALL)
SELECT r.run_id, r.m AS n, round(eta, 2) AS viscosity_upas, done FROM r JOIN z ON z.run_id = r.run_id AND z.m = r.m"""


def stream_settled(spark: SparkSession, d: str) -> DataFrame:
    """Runs that stop at a standard error of 12 or after 25 results."""
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("run_id"), "value", "ts", "event_id")
    df = _drained(streams.settle(e, 12.0, 2, 25, ["ts", "event_id"]), "stream_settled", "update")
    return J.latest(df, ["run_id"], [F.col("batch")]).select("run_id", "n", F.round("mean", 9).alias("mean"), F.round("sem", 8).alias("sem"), "done")


STREAM_SETTLED = """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) OVER w AS n, count(*) OVER (PARTITION BY user_id) AS total, avg(value) OVER w AS mean, coalesce(stddev_samp(value) OVER w / sqrt(count(*) OVER w), 0) AS sem
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, n >= 25 OR n >= 2 AND sem < 12.0 AS done FROM r)
SELECT run_id, min(n) AS n, round(arg_min(mean, n), 9) AS mean, round(arg_min(sem, n), 8) AS sem, arg_min(done, n) AS done FROM s WHERE done OR n = total GROUP BY run_id"""


def search(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of one composition (a label), then the ten nearest others, all tagged 'even'."""
    v = _vectors(spark, d).select("job_id", "elemental_vector", F.lit("completed").alias("status"), F.col("label").cast("string").alias("composition"), F.array(F.when(F.col("job_id") % 2 == 0, "even").otherwise("odd")).alias("tags"))
    got = J.search(v, "2", [0.125] * 64, tags=["even"], threshold=10.0, most=10)
    return got.select("job_id", "match", F.round("distance", 4).alias("distance"))


SEARCH = """WITH v AS (SELECT vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), list_resize([]::DOUBLE[], 64, 0.125)) AS d FROM embeddings),
c AS (SELECT * FROM v WHERE label <> 2 ORDER BY d, vec_id LIMIT 10)
SELECT vec_id AS job_id, 'exact' AS "match", 0.0::DOUBLE AS distance FROM v WHERE label = 2 AND vec_id % 2 = 0 UNION ALL SELECT vec_id, 'close', round(d, 4) FROM c WHERE vec_id % 2 = 0"""


QUERIES = {
    "jobs_search": search, "jobs_latest": latest, "jobs_cache_hit": hits, "jobs_list": listing, "vector_topk": topk, "tags_filter": tags, "missing_analyses": missing, "step_status": step_status,
    "job_status": status, "step_timings": timings, "request_hash": hashes, "merged_results": merged, "stream_status": stream_status, "stream_rates": stream_rates, "stream_settled": stream_settled,
    "stream_lifecycle": stream_lifecycle, "stream_viscosity": stream_viscosity, "vector_nearest": vector_nearest, "request_documents": request_documents,
}
ORACLES = {
    "jobs_search": SEARCH, "jobs_latest": LATEST, "jobs_cache_hit": HITS, "jobs_list": LISTING, "vector_topk": TOPK, "tags_filter": TAGS, "missing_analyses": MISSING, "step_status": STEP_STATUS,
    "job_status": STATUS, "step_timings": TIMINGS, "request_hash": HASHES, "merged_results": MERGED, "stream_status": STREAM_STATUS, "stream_rates": STREAM_RATES,
    "stream_settled": STREAM_SETTLED, "stream_lifecycle": STREAM_LIFECYCLE, "stream_viscosity": STREAM_VISCOSITY, "vector_nearest": VECTOR_NEAREST, "request_documents": REQUEST_DOCUMENTS,
}
