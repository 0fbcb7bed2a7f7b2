"""Mergeable moment records: counts, means and co-moments of a group's rows, which later rows extend without being read again.

A record holds, for the columns c of a group: n, mean_<c> and, for each pair a <= b of their order, m_<a>_<b>, the sum of
(a - mean a)(b - mean b). Records of disjoint rows merge exactly, whatever the rows' number; all of it is partial aggregation.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def records(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n, mean_ and m_ of the rows that have all columns."""
    whole = df.dropna(subset=columns)
    aggs = [F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in columns)]
    aggs += [(F.covar_pop(a, b) * F.count("*")).alias(f"m_{a}_{b}") for a, b in combinations_with_replacement(columns, 2)]
    return whole.groupBy(*by).agg(*aggs)


def merged(parts: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One record a group of those that parts holds of it: the means' spread between the parts joins the spread within them."""
    n = F.sum("n")
    aggs = [n.alias("n"), *((F.sum(F.col("n") * F.col(f"mean_{c}")) / n).alias(f"mean_{c}") for c in columns)]
    for a, b in combinations_with_replacement(columns, 2):
        # weighted by n, co-moments of the parts' means about the merged mean; means are shifted by one part's to keep digits
        x, y = F.col(f"mean_{a}") - F.col(f"_o_{a}"), F.col(f"mean_{b}") - F.col(f"_o_{b}")
        between = F.sum(F.col("n") * x * y) - F.sum(F.col("n") * x) * F.sum(F.col("n") * y) / n
        aggs.append((F.sum(f"m_{a}_{b}") + between).alias(f"m_{a}_{b}"))
    origin = parts.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg(*(F.min(f"mean_{c}").alias(f"_o_{c}") for c in columns))
    cond = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return parts.join(origin, cond).groupBy(*by).agg(*aggs)


class Increments:
    """Records of a growing series of runs, appended under a path; reading them never reads the runs' rows.

    Each increment is written under its own name, so that writing it again, after a failure, replaces it instead of counting it twice.
    """

    def __init__(self, spark, path: str, by: list[str], columns: list[str]):
        self.spark, self.path, self.by, self.columns = spark, path.rstrip("/"), by, columns

    def add(self, name: str, df: DataFrame) -> None:
        records(df, self.by, self.columns).write.mode("overwrite").parquet(f"{self.path}/increment={name}")

    def now(self) -> DataFrame:
        return merged(self.spark.read.parquet(self.path).drop("increment"), self.by, self.columns)


def covariance(a: str, b: str) -> Column:
    return F.col(f"m_{a}_{b}") / F.col("n")


def fluctuation_expansion(found: DataFrame, h: str, size: str, temperature: Column) -> DataFrame:
    """found with cte: covariance of enthalpy and size over mean size, k_B and T squared."""
    return found.withColumn("cte", covariance(h, size) / (F.col(f"mean_{size}") * C.K_B_EV * temperature * temperature))


def fitted_expansion(found: DataFrame, by: list[str], t: str, size: str) -> DataFrame:
    """by, slope, cte, r2 of size over temperature from records by a finer key: the line through all their rows, relative to the
    mean size of the record of lowest mean temperature."""
    one = merged(found, by, [t, size])
    low = found.groupBy(*by).agg(F.min_by(f"mean_{size}", f"mean_{t}").alias("_low"))
    slope = F.col(f"m_{t}_{size}") / F.nullif(F.col(f"m_{t}_{t}"), F.lit(0.0))
    r2 = F.col(f"m_{t}_{size}") ** 2 / F.nullif(F.col(f"m_{t}_{t}") * F.col(f"m_{size}_{size}"), F.lit(0.0))
    return one.join(low, by).select(*by, slope.alias("slope"), (slope / F.col("_low")).alias("cte"), r2.alias("r2"))
