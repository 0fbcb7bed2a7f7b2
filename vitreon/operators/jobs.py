"""Job tables: append-only versions, latest rows, cache hits, searches, tags, steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest(jobs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last version of every key. max_by keeps one row per key and task, where a window would sort all versions."""
    rest = [c for c in jobs.columns if c not in key]
    got = jobs.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def append(jobs: DataFrame, job_id: str, fields: dict) -> DataFrame:
    """The next version of a job with these fields changed; no row if the id is unknown."""
    now = latest(jobs.where(F.col("job_id") == job_id), ["job_id"], [F.col("version")])
    return now.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()} | {"version": F.col("version") + 1}).select(*jobs.columns)


def cancel(jobs: DataFrame, job_id: str) -> DataFrame:
    """The version that cancels a pending or running job; no row for any other."""
    return append(jobs, job_id, {"status": "cancelled"}).join(
        latest(jobs, ["job_id"], [F.col("version")]).where(F.col("status").isin("pending", "running")).select("job_id"), "job_id", "left_semi"
    ).select(*jobs.columns)


def cache_hits(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (request_hash) with job_id of the newest completed job of that hash that has a result; null if none."""
    done = jobs.where("status = 'completed' and result_data is not null")
    best = done.groupBy("request_hash").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))
    return requests.join(best, "request_hash", "left")


def by_composition(jobs: DataFrame, composition: str, potential: str | None = None) -> DataFrame:
    df = jobs.where((F.col("status") == "completed") & (F.col("composition") == composition))
    return (df if potential is None else df.where(F.col("potential") == potential)).orderBy(F.desc("created_at"), "job_id")


def composition_counts(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'completed'").groupBy("composition").agg(F.count("*").alias("n_jobs"))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def close_matches(query: list[float], jobs: DataFrame, exclude: DataFrame | None = None, threshold: float = 0.05, most: int = 10) -> DataFrame:
    """The nearest completed jobs by element vector within the threshold: distance, similarity = 1 / (1 + distance)."""
    df = jobs.where("elemental_vector is not null")
    if exclude is not None:
        df = df.join(exclude.select("job_id"), "job_id", "left_anti")
    d = euclid(F.col("elemental_vector"), F.array(*(F.lit(float(v)) for v in query)))
    near = df.withColumn("distance", d).where(F.col("distance") <= threshold).orderBy("distance", "job_id").limit(most)
    return near.withColumns({"similarity": F.round(1 / (1 + F.col("distance")), 4), "distance": F.round("distance", 4)})


def search(jobs: DataFrame, composition: str, query: list[float], potential: str | None = None, tags: list[str] | None = None, analyses: list[str] | None = None, threshold: float = 0.05, most: int = 10) -> DataFrame:
    """Exact matches (distance 0) and then close ones; all given tags and analyses must be there."""
    done = jobs.where("status = 'completed'")
    done = done if potential is None else done.where(F.col("potential") == potential)
    exact = done.where(F.col("composition") == composition).withColumns({"distance": F.lit(0.0), "similarity": F.lit(1.0), "match": F.lit("exact")})
    close = close_matches(query, done, exact, threshold, most).withColumn("match", F.lit("close"))
    out = exact.unionByName(close)
    for col, want in (("tags", tags), ("analyses", analyses)):
        if want:
            out = out.where(F.size(F.array_except(F.array(*map(F.lit, want)), F.coalesce(col, F.array().cast("array<string>")))) == 0)
    return out


def merged_tags(*tags: Column) -> Column:
    """Sorted distinct union; null counts as none."""
    empty = F.array().cast("array<string>")
    out = empty
    for t in tags:
        out = F.array_union(out, F.coalesce(t, empty))
    return F.array_sort(out)


def missing(present: Column, wanted: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, wanted)), present)


def documents(rows: DataFrame, column: str) -> DataFrame:
    """rows with v (the JSON document of a column as a variant, null if it is broken), analyses (the types of its list of that name) and
    numbers (the atomic numbers of its structure, which may be an object or JSON in a string; null if there are none)."""
    df = rows.withColumn("v", F.try_parse_json(column))
    kinds = F.filter(F.transform(F.coalesce(F.try_variant_get("v", "$.analyses", "array<variant>"), F.array().cast("array<variant>")), lambda a: F.try_variant_get(a, "$.type", "string")), lambda t: t.isNotNull())
    nested = F.try_parse_json(F.try_variant_get("v", "$.structure", "string"))
    numbers = F.coalesce(F.try_variant_get("v", "$.structure.numbers", "array<int>"), F.try_variant_get(nested, "$.numbers", "array<int>"))
    return df.withColumns({"analyses": kinds, "numbers": numbers})


def first_parameter(document: Column, kind: str, name: str, as_type: str) -> Column:
    """A parameter of the first analysis of a kind in a document (variant); null if there is none."""
    fits = F.filter(F.try_variant_get(document, "$.analyses", "array<variant>"), lambda a: F.try_variant_get(a, "$.type", "string") == kind)
    return F.try_variant_get(F.get(fits, F.lit(0)), f"$.{name}", as_type)


def request_hash(fields: dict[str, Column]) -> Column:
    """First 16 hex digits of SHA-256 over the JSON of the fields in order of their names."""
    return F.substring(F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items())))), 256), 1, 16)


def merged_results(base: Column, *others: Column) -> Column:
    """Union of maps in which later ones win."""
    out = base
    for m in others:
        out = F.map_concat(_without(out, F.map_keys(m)), m)
    return out


def _without(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.array_contains(keys, k))


def step_status(events: DataFrame, base: str) -> DataFrame:
    """job_id, step, status, error of the last event of every step; other steps are pending until base is completed."""
    now = events.groupBy("job_id", "step").agg(F.max_by(F.struct("status", "error"), F.struct("ts", "event_id")).alias("s"))
    done = F.bool_or((F.col("step") == base) & (F.col("s.status") == "completed")).over(W.partitionBy("job_id"))
    return now.select("job_id", "step", F.when((F.col("step") == base) | done, F.col("s.status")).otherwise("pending").alias("status"), F.col("s.error").alias("error"))


def job_status(steps: DataFrame) -> DataFrame:
    """job_id, status: failed if a step failed, completed if all are, running if one runs or is completed, else pending."""
    s = F.col("status")
    got = steps.groupBy("job_id").agg(F.bool_or(s == "failed").alias("f"), F.bool_and(s == "completed").alias("c"), F.bool_or(s.isin("running", "completed")).alias("r"))
    return got.select("job_id", F.when(F.col("f"), "failed").when(F.col("c"), "completed").when(F.col("r"), "running").otherwise("pending").alias("status"))


def runtime_text(seconds: Column) -> Column:
    """'12.3 s', '4.5 min' or '6.7 h'."""
    return F.when(seconds < 60, F.format_string("%.1f s", seconds)).when(seconds < 3600, F.format_string("%.1f min", seconds / 60)).otherwise(F.format_string("%.1f h", seconds / 3600))


def timings(steps: DataFrame) -> DataFrame:
    """job_id, seconds, core_hours, text of the steps (job_id, seconds, cores) that ran."""
    got = steps.where("seconds > 0").groupBy("job_id").agg(F.sum("seconds").alias("seconds"), (F.sum(F.col("seconds") * F.col("cores")) / 3600).alias("core_hours"))
    return got.withColumn("text", runtime_text(F.col("seconds")))


def similarity(distance: Column) -> Column:
    return F.round(1 / (1 + distance), 4)
