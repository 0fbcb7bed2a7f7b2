"""Series that are too long for one task: numbered by a sort over ranges, then worked on in blocks of rows.

A run's rows are sorted into ranges across the cluster; the ranges' counts give every row its number. A block is so many
consecutive rows. Running sums are sums within a block on top of the sums of the blocks before it; windows and lags get the rows
next to a block copied into it; correlations come from pairs of blocks. No task holds more than a block or a pair, however long a run is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Stored

#: Rows of a block.
BLOCK = 1 << 16


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def placed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with _pos, the row's number from 0 on in its run in the order of these columns, which tell a run's rows apart."""
    keys = [*by, *order]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = Stored(df.sparkSession, "long").keep(sorted_.withColumn("_part", F.shiftright("_at", 33)))
    names = [f"_by{i}" for i in range(len(by))]
    counts = ranged.groupBy(*(F.col(c).alias(x) for c, x in zip(by, names, strict=True)), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*names).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    met = ranged.join(counts, _same(by, names) & (F.col("_part") == F.col("_p")))
    return met.withColumn("_pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_p", "_first", "_n", "_before", *names)


def _blocks(df: DataFrame, before: int, after: int, block: int) -> DataFrame:
    """df with _block and _own; rows at a block's edges stand in the blocks beside it too, not as their own."""
    if max(before, after) > block:
        raise ValueError("windows reach over whole blocks: take larger ones")
    b, at = F.floor(F.col("_pos") / block), F.col("_pos") % block
    place = F.array(b, *([F.when(at >= block - before, b + 1)] if before else []), *([F.when((at < after) & (b > 0), b - 1)] if after else []))
    return df.withColumn("_block", F.explode(F.filter(place, lambda x: x.isNotNull()))).withColumn("_own", F.col("_block") == b)


def running_mean(df: DataFrame, by: list[str], value: str, n: int, name: str = "mean", block: int = BLOCK) -> DataFrame:
    """Centred mean of n values as series.running_mean gives it, of placed() rows."""
    low, high = n // 2, n - n // 2 - 1
    w = W.partitionBy(*by, "_block").orderBy("_pos").rowsBetween(-low, high)
    got = _blocks(df, low, high, block).withColumn(name, F.when(F.count(F.lit(1)).over(w) == n, F.avg(value).over(w)))
    return got.where("_own").drop("_block", "_own")


def running_sums(df: DataFrame, by: list[str], sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """df with the running sums of these expressions, null counting as 0."""
    names = [f"_by{i}" for i in range(len(by))]
    rows = df.withColumn("_block", F.floor(F.col("_pos") / block)).withColumns({f"_in_v{i}": F.coalesce(c, F.lit(0.0)) for i, c in enumerate(sums.values())})
    part = rows.groupBy(*(F.col(c).alias(x) for c, x in zip(by, names, strict=True)), F.col("_block").alias("_b")).agg(*(F.sum(f"_in_v{i}").alias(f"_in_s{i}") for i in range(len(sums))))
    up = W.partitionBy(*names).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    part = part.select(*names, "_b", *(F.coalesce(F.sum(f"_in_s{i}").over(up), F.lit(0.0)).alias(f"_in_o{i}") for i in range(len(sums))))
    here = W.partitionBy(*by, "_block").orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"_in_c{i}": F.sum(f"_in_v{i}").over(here) for i in range(len(sums))}).join(part, _same(by, names) & (F.col("_block") == F.col("_b")))
    out = rows.withColumns({k: F.col(f"_in_o{i}") + F.col(f"_in_c{i}") for i, k in enumerate(sums)})
    return out.drop("_block", "_b", *names, *(f"_in_{x}{i}" for x in "vsoc" for i in range(len(sums))))


def cumulative_trapezoid(df: DataFrame, by: list[str], value: str, dt: Column, name: str = "integral", block: int = BLOCK) -> DataFrame:
    """Running trapezoid with step dt, first value 0, of placed() rows."""
    before = F.lag(value).over(W.partitionBy(*by, "_block").orderBy("_pos"))
    got = _blocks(df, 1, 0, block).withColumn("_step", (F.col(value) + before) * 0.5 * dt).where("_own").drop("_block", "_own")
    return running_sums(got, by, {name: F.col("_step")}, block).drop("_step")


def cumulative_sem(df: DataFrame, by: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """Running mean and its standard error (0 for the first row), of placed() rows: sums are taken about the run's first value."""
    names = [f"_by{i}" for i in range(len(by))]
    first = df.where("_pos = 0").select(*(F.col(c).alias(x) for c, x in zip(by, names, strict=True)), F.col(value).alias("_x0"))
    d = F.col(value) - F.col("_x0")
    got = running_sums(df.join(first, _same(by, names)).drop(*names), by, {"_s1": d, "_s2": d * d}, block)
    n = F.col("_pos") + 1
    var = F.greatest(F.lit(0.0), F.col("_s2") - F.col("_s1") * F.col("_s1") / n) / (n - 1)
    return got.withColumns({"mean": F.col("_x0") + F.col("_s1") / n, "sem": F.when(n > 1, F.sqrt(F.when(n > 1, var) / n)).otherwise(0.0)}).drop("_s1", "_s2", "_x0")


def block_for(n: int, least: int = BLOCK) -> int:
    """Rows of a block so that a run of n rows has at most 32 blocks, as pairs grow with their square; 2^20 rows at most."""
    return max(least, min(1 << 20, 1 << max(0, -(-n // 32) - 1).bit_length()))


def acf(df: DataFrame, by: list[str], value: str, max_lag: int | None = None, block: int = BLOCK) -> DataFrame:
    """by, lag, acf of placed() rows: unbiased, the mean not removed, for all lags of a run below max_lag (null: all).

    A pair of blocks gives the products of its rows by their distance, through one Fourier transform; pairs are those at most as far
    apart as the longest lag. Pairs of one distance are dealt together, so that their sums leave a task once.
    """
    spark_by = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))]
    one = df.groupBy(*spark_by, F.floor(F.col("_pos") / block).alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.col(value).cast("double").alias("y")))), lambda r: r["y"]).alias("x"))
    one = Stored(df.sparkSession, "acf").keep(one)
    size = one.groupBy(*(F.col(c).alias(f"_n{c}") for c in names)).agg(F.sum(F.size("x")).alias("n"), F.max("b").alias("last"))
    most = F.lit(max_lag).cast("bigint") if max_lag is not None else F.col("n")
    reach = F.least(F.col("last") - F.col("b"), F.floor((most + block - 2) / block))
    left = one.join(size, _same(names, [f"_n{c}" for c in names])).drop(*(f"_n{c}" for c in names))
    left = left.withColumn("d", F.explode(F.sequence(F.lit(0).cast("bigint"), reach))).withColumn("j", F.col("b") + F.col("d"))
    right = one.select(*(F.col(c).alias(f"_r{c}") for c in names), F.col("b").alias("_b"), F.col("x").alias("z"))
    pairs = left.join(right, _same(names, [f"_r{c}" for c in names]) & (F.col("j") == F.col("_b"))).select(F.struct(*names).alias("run"), "n", "d", "x", "z", (F.col("j") % 4).alias("_deal"))
    pairs = pairs.repartition("run", "d", "_deal").drop("_deal")
    kinds = pairs.schema["run"].dataType

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}  # by run, its rows, and the least lag of the array
        runs: dict[tuple, object] = {}
        size = 0

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([{"run": runs[k[0]], "n": k[1], "low": k[2], "s": v} for k, v in held.items()], columns=["run", "n", "low", "s"])
            held.clear()
            return out

        for b in batches:
            for run, n, d, x, z in zip(b["run"].tolist(), b["n"].tolist(), b["d"].tolist(), b["x"], b["z"], strict=True):
                f = 1 << (len(x) + len(z) - 1).bit_length()
                c = np.fft.irfft(np.conj(np.fft.rfft(x, f)) * np.fft.rfft(z, f), f)
                # distances of a row of z from one of x run from 1 - len(x) to len(z) - 1, and len(x) is a block but for d = 0
                low = d * block - (block - 1) if d else 0
                s = np.zeros(min(n, d * block + block) - low)
                s[d * block - low : d * block - low + len(z)] = c[: len(z)]
                if d and len(x) > 1:
                    s[d * block - low - len(x) + 1 : d * block - low] = c[1 - len(x) :]
                key = (tuple(run.values()) if isinstance(run, dict) else tuple(run), n, low)
                runs[key[0]] = run
                if key in held:
                    held[key] += s
                else:
                    held[key] = s
                    size += len(s)
                if size > 1 << 22:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    schema = StructType([StructField("run", kinds), StructField("n", LongType()), StructField("low", LongType()), StructField("s", ArrayType(DoubleType()))])
    sums = pairs.mapInPandas(products, schema).select("run", "n", "low", F.posexplode("s").alias("k", "s"))
    rows = sums.withColumn("lag", F.col("low") + F.col("k")).where(F.col("lag") < F.least(F.col("n"), most))
    out = rows.groupBy("run", "n", "lag").agg(F.sum("s").alias("s"))
    return out.select(*(F.col(f"run.{x}").alias(c) for x, c in zip(names, by, strict=True)), F.col("lag").cast("int").alias("lag"), (F.col("s") / (F.col("n") - F.col("lag"))).alias("acf"))
