"""Requests become jobs: a batch of them is normalised, completed, hashed, and met with the finished jobs, all as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import composition as K
from ..operators import jobs as J

#: How far amounts may be from adding up to 1 or 100.
TOLERANCE = 0.03


def resolve(requests: DataFrame, compositions: DataFrame, default: str = "pmmcs") -> DataFrame:
    """requests with error (null: none), composition (canonical mol%), potential, density and request_hash filled in.

    requests: comp_id, potential (or null: the default, or the best that covers the elements), density (or null: that of
    the model), settings (map, may be null). compositions: comp_id, pos, oxide, amount. Every request has a row;
    error is the first fault: composition (invalid, with its kind), potential (unsupported or none) or density (the
    model doesn't know a component).
    """
    asked = requests.select("comp_id", "potential", F.col("density").alias("_asked"), "settings", *(c for c in requests.columns if c not in ("comp_id", "potential", "density", "settings")))
    checked = K.check(compositions, TOLERANCE).select("comp_id", F.col("status").alias("_fault"))
    good = K.extract(compositions, TOLERANCE)
    names = K.canonical(good.select("comp_id", "oxide", (F.col("fraction") * 100).alias("amount"))).withColumnRenamed("canonical", "composition")
    elements = K.element_fractions(good.withColumn("amount", F.col("fraction"))).select("comp_id", "element")
    chosen = K.choose_potential(requests.select("comp_id", "potential"), elements, default).select("comp_id", "chosen", F.col("status").alias("_potential"))
    model = K.density(good).withColumnRenamed("density", "_model")
    df = asked.join(checked, "comp_id", "left").join(names, "comp_id", "left").join(chosen, "comp_id", "left").join(model, "comp_id", "left")
    density = F.coalesce("_asked", "_model")
    fault = (
        F.when(F.coalesce("_fault", F.lit("missing")) != "ok", F.concat(F.lit("composition: "), F.coalesce("_fault", F.lit("missing"))))
        .when(F.col("_potential") != "ok", F.concat(F.lit("potential: "), "_potential"))
        .when(density.isNull(), F.lit("density: unknown to the model"))
    )
    settings = F.coalesce("settings", F.create_map().cast("map<string,string>"))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(settings)))
    made = J.request_hash({"composition": F.col("composition"), "potential": F.col("chosen"), "density": F.round(density, 6), "settings": ordered})
    df = df.withColumns({"error": fault, "potential": F.col("chosen"), "density": density, "settings": settings})
    return df.withColumn("request_hash", F.when(F.col("error").isNull(), made)).drop("_fault", "chosen", "_potential", "_asked", "_model")


def submit(requests: DataFrame, compositions: DataFrame, jobs: DataFrame, batch: str, force: bool = False, default: str = "pmmcs") -> DataFrame:
    """resolve()'s rows with job_id, status, hit and tags.

    A request whose hash a completed job with a result has (the newest counts) is a hit and adds its tags (array) to that
    job's; force looks at no finished job. All others get a new id, made of the batch's name and the request, and are
    pending; requests with an error have no id. jobs: the last version of each.
    """
    df = resolve(requests, compositions, default)
    done = jobs.where("status = 'completed' and result_data is not null")
    done = done.groupBy("request_hash").agg(F.max_by(F.struct("job_id", "tags"), F.struct("created_at", "job_id")).alias("_j"))
    df = df.join(done.where(F.lit(not force)), "request_hash", "left")
    good, hit = F.col("error").isNull(), F.col("_j").isNotNull()
    fresh = F.substring(F.sha2(F.concat_ws("|", F.lit(batch), F.col("comp_id").cast("string"), "request_hash"), 256), 1, 32)
    status: Column = F.when(~good, None).when(hit, "completed").otherwise("pending")
    tags = F.when(hit, J.merged_tags(F.col("_j.tags"), F.col("tags"))).otherwise(J.merged_tags(F.col("tags")))
    return df.withColumns({"job_id": F.when(good, F.coalesce("_j.job_id", fresh)), "status": status, "hit": good & hit, "tags": tags}).drop("_j")
