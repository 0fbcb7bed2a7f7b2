"""The nearest vectors for a table of vectors, exactly: cells around pivots, and what the triangle inequality leaves of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Stored

#: Pivots, drawn by hash of id; queries and rows of a block. RINGS is kept for callers.
PIVOTS, RINGS, BLOCK = 64, 64, 8192


def _gaps(v: pd.Series, p: np.ndarray) -> np.ndarray:
    """Distances of vectors to all pivots."""
    x = np.stack(v.to_numpy()).astype(float)
    return np.vstack([np.sqrt(((x[i : i + 256, None, :] - p[None]) ** 2).sum(axis=2)) for i in range(0, len(x), 256)])


def _best(asked: pd.DataFrame, rows: pd.DataFrame, k: int, chunk: int = 128) -> pd.DataFrame:
    """query_id, id, distance, n of the k nearest of these rows to each query, among those that its limit leaves; n, at a query's first row, is
    how many these are. Products find whom the k nearest can be; their distances are then summed as they stand."""
    rows = rows.sort_values("r")
    r, ids, x = rows["r"].to_numpy(float), rows["id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(float)
    asked = asked.sort_values("d")
    d, limit = asked["d"].to_numpy(float), asked["limit"].to_numpy(float)
    q, names = np.stack(asked["_q"].to_numpy()).astype(float), asked["query_id"].to_numpy()
    reach = np.where(np.isnan(limit), np.inf, limit)
    # the limit holds for |d - r| as it is computed, so the ends are looked at a little wider
    first, last = np.searchsorted(r, d - reach - 1e-9 * (1 + d), "left"), np.searchsorted(r, d + reach + 1e-9 * (1 + d), "right")
    square, own, out = (x * x).sum(axis=1), (q * q).sum(axis=1), []
    for lo in range(0, len(q), chunk):
        hi = min(lo + chunk, len(q))
        a, b = int(first[lo:hi].min()), int(last[lo:hi].max())
        if a >= b:
            continue
        on = (np.abs(d[lo:hi, None] - r[None, a:b]) <= reach[lo:hi, None]) & (names[lo:hi, None] != ids[None, a:b])
        n = on.sum(axis=1)
        near = np.where(on, own[lo:hi, None] + square[None, a:b] - 2 * (q[lo:hi] @ x[a:b].T), np.inf)
        kth = np.partition(near, k - 1, axis=1)[:, k - 1] if k < b - a else np.full(hi - lo, np.inf)
        slack = 1e-10 * (own[lo:hi] + square[a:b].max()) + 1e-300
        i, j = np.nonzero(on & (near <= (kth + slack)[:, None]))
        gap = q[lo + i] - x[a + j]
        exact = np.sqrt(np.add.accumulate(gap * gap, axis=1)[:, -1])
        found = pd.DataFrame({"query_id": names[lo + i], "id": ids[a + j], "distance": exact}).sort_values(["query_id", "distance", "id"])
        found = found[found.groupby("query_id").cumcount() < k]
        found["n"] = np.where(found["query_id"].duplicated(), 0, found["query_id"].map(dict(zip(names[lo:hi], n.tolist(), strict=True))))
        out.append(found)
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "id", "distance", "n")})


def nearest(queries: DataFrame, rows: DataFrame, k: int, pivots: int = PIVOTS, rings: int = RINGS) -> DataFrame:
    """query_id, rank, id, distance, compared: the k rows (id, vector) nearest to each query (query_id, vector) by distance, then id; compared
    is the number of rows whose distance was computed. A row of the query's own id doesn't count.

    Every row lies in the cell of its nearest pivot. A query's k-th distance is at most that to a pivot and
    the k-th distance of a row to that pivot; a row can only be nearer than that if its distance to its pivot differs from the query's
    by no more. Blocks of queries meet blocks of the cells that this leaves, a pair of blocks a group, as products of matrices; of every
    pair only the k nearest go on. Null vectors, or such of another length than the pivots, are left out. rings is without effect now.
    """
    spark, stored = rows.sparkSession, Stored(rows.sparkSession, "nearest")
    rows = rows.where("vector is not null and id is not null")
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # a fixed number
    if not chosen:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, id {rows.schema['id'].dataType.simpleString()}, distance double, compared bigint")
    size = len(chosen[0]["vector"])
    p = np.array([r["vector"] for r in chosen if len(r["vector"]) == size], float)

    @F.pandas_udf("struct<cell:int,r:double>")
    def place(v: pd.Series) -> pd.DataFrame:
        d = _gaps(v, p)
        return pd.DataFrame({"cell": d.argmin(axis=1).astype(np.int32), "r": d.min(axis=1)})

    @F.pandas_udf("array<double>")
    def gaps(v: pd.Series) -> pd.Series:
        return pd.Series(list(_gaps(v, p)))

    placed = rows.where(F.size("vector") == size).withColumn("_p", place("vector")).select("id", "vector", "_p.cell", "_p.r")
    placed = stored.keep(placed)
    # one row a cell: its reach, and the distance of its (k + 1)-th row, since one may be the query itself
    order = F.row_number().over(W.partitionBy("cell").orderBy("r"))
    near = placed.select("cell", "r").withColumn("_n", order).where(F.col("_n") <= k + 1).groupBy("cell").agg(F.max("r").alias("kth"), F.count("*").alias("n"))
    cells = placed.groupBy("cell").agg(F.max("r").alias("far")).join(near, "cell").withColumn("kth", F.when(F.col("n") > k, F.col("kth"))).drop("n")
    cells = cells.join(placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cell")
    queries = queries.where(F.size("vector") == size)
    parts = max(1, -(-queries.count() // BLOCK))
    asked = queries.select("query_id", "vector", F.posexplode(gaps("vector")).alias("cell", "d")).join(cells, "cell")
    limit = F.min(F.col("d") + F.col("kth")).over(W.partitionBy("query_id")) * (1 + 1e-12) + 1e-12
    asked = asked.withColumn("limit", limit).where(F.coalesce(F.col("d") - F.col("limit"), F.lit(0.0)) <= F.col("far"))
    asked = asked.select("query_id", F.col("vector").alias("_q"), "cell", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "d", "limit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = placed.join(cells.select("cell", "blocks"), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (rows, "id"))]
    key = ["cell", "block", "part"]
    met = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(lambda a, b: _best(a, b, k) if len(a) and len(b) else a.head(0).assign(id=[], distance=[], n=[])[["query_id", "id", "distance", "n"]], f"query_id {kinds[0]}, id {kinds[1]}, distance double, n bigint")
    met = stored.keep(met)
    n = met.groupBy("query_id").agg(F.sum("n").alias("compared"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).join(n, "query_id").select("query_id", "rank", "id", "distance", "compared")
