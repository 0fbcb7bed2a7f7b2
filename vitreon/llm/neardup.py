"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one kept per group.

Equal vectors collapse into classes first. A class is at home in the cell of its nearest centroid and visits every cell
whose centroid is at most MARGIN less similar, because two vectors with cosine 0.95 may have different homes; a pair
is compared where one of the two is at home. The centroids come from a bounded sample, but every vector is indexed. There
are as many cells as the square root of the classes, so that both assignment and products grow with n * sqrt(n). The
homes and the visitors of a cell are dealt into blocks of at most BLOCK classes; two blocks make one group of one
matrix product in double precision, so a cell that holds a third of all vectors becomes many equal tasks. A pair that
meets in both homes counts in the lower one. A group returns link counts and a spanning forest of its links, never
its pairs. Single-precision vectors travel as such.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, tidy

COSINE = 0.95
#: How much less similar than the best a centroid may be for a vector to visit its cell.
MARGIN = 0.13
#: Vectors the centroids are fitted on at most, classes a cell holds on average at least, and cells at most: the
#: centroids are broadcast.
SAMPLE, PER_CELL, CELLS = 50_000, 64, 16_384
BLOCK = 2048
ROUNDS = 8


def centroids(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors, started from evenly spaced rows; an empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def unit(raw: list[bytes], form: str = "<f8") -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(raw), form).reshape(len(raw), -1).astype("<f8")
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(table: DataFrame, form: str) -> DataFrame:
    """vec_id and raw (the vector's numbers as bytes; null if it can link with nothing)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1):
                if not v.is_valid or v.values is None or not len(v.values) or v.values.null_count:
                    out.append(None)
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(form) + np.zeros(1, form)  # -0 is 0
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["vec_id", "raw"])

    kind = "array<float>" if form == "<f4" else "array<double>"
    return table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).mapInArrow(run, "vec_id bigint, raw binary")


def link(vectors: DataFrame, cosine: float = COSINE, margin: float = MARGIN) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept;
    vectors of different length never link. Rows that repeat a vec_id count as vectors of their own and share its
    component; a null vec_id gets null component and kept. Other columns are ignored; an empty table gives an
    empty one.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    form = "<f4" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull) else "<f8"
    width = int(form[-1])
    rows = scratch.keep(usable(vectors, form), "raw")
    good = rows.where("raw is not null and vec_id is not null")
    classes = scratch.keep(good.groupBy("raw").agg(F.min("vec_id").alias("cid"), F.count("*").alias("size")), "classes")
    n = classes.count()
    length = classes.groupBy(F.octet_length("raw").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = length["d"] if length else width
    sample = classes.where(F.octet_length("raw") == dim).orderBy(F.xxhash64("cid")).limit(SAMPLE).select("raw").collect()
    k = max(1, min(CELLS, n // PER_CELL, isqrt(n)))
    centers = centroids(unit([bytes(r["raw"]) for r in sample], form), k) if sample else np.zeros((1, dim // width))
    model = spark.sparkContext.broadcast(centers)

    @tidy
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.value
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                raw = [v.as_py() for v in part.column(2)]
                fit = [j for j, r in enumerate(raw) if len(r) == dim]
                where: list = [[len(c) + len(r) // width] for r in raw]  # another length: a cell of its own
                if fit:
                    s = unit([raw[j] for j in fit], form) @ c.T
                    home = s.argmax(1)
                    near = s >= s.max(1, keepdims=True) - margin
                    near[np.arange(len(fit)), home] = False
                    for j, h, m in zip(fit, home.tolist(), near, strict=True):
                        where[j] = [h, *np.flatnonzero(m).tolist()]
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array(where, pa.list_(pa.int32()))], ["cid", "size", "raw", "cells"])

    placed = scratch.keep(classes.select("cid", "size", "raw").mapInArrow(assign, "cid bigint, size bigint, raw binary, cells array<int>"), "placed")
    spread = placed.select("*", F.posexplode("cells").alias("_at", "cell")).withColumn("home", F.col("_at") == 0)
    # one row a cell: CELLS, and one a vector length
    held = spread.groupBy("cell").agg(*(F.ceil(F.count(F.when(c, 1)) / BLOCK).cast("int").alias(name) for c, name in ((F.col("home"), "homes"), (~F.col("home"), "guests"))))
    spread = spread.join(F.broadcast(held.where("homes > 0")), "cell")
    block = F.pmod(F.xxhash64("cid"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    # kind 0: all of a cell; 1: two blocks of homes (or one with itself); 2: one of homes, one of guests
    to = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    own = F.concat(F.transform(upto("homes"), lambda o: to(1, F.least("_b", o), F.greatest("_b", o))), F.transform(upto("guests"), lambda o: to(2, F.col("_b"), o)))
    away = F.transform(upto("homes"), lambda o: to(2, o, F.col("_b")))
    groups = F.when((F.col("homes") == 1) & (F.col("guests") <= 1), F.array(to(0, F.lit(0), F.lit(0)))).otherwise(F.when(F.col("home"), own).otherwise(away))
    spread = spread.withColumn("_b", block).withColumn("_g", F.explode(groups))
    spread = spread.select("cell", "_g.*", ((F.col("_g.kind") == 2) & ~F.col("home") | (F.col("_g.kind") == 1) & (F.col("_b") > F.col("_g.lo"))).alias("right"), "home", "cid", "size", "raw", "cells")

    def products(table: pa.Table) -> pa.Table:
        cell, kind = table.column("cell")[0].as_py(), table.column("kind")[0].as_py()
        right, home = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("right", "home"))
        cid, size = table.column("cid").to_numpy(), table.column("size").to_numpy()
        x = unit(table.column("raw").to_pylist(), form)
        alone = kind == 0 or kind == 1 and table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        left = np.flatnonzero(home & ~right)
        other = np.arange(len(cid)) if alone else np.flatnonzero(right)
        s = x[left] @ x[other].T >= cosine
        if alone:
            s[np.arange(len(left)), left] = False
        cells = [tuple(c) for c in table.column("cells").to_pylist()]
        base = np.array([c[0] for c in cells])
        guests = ~home[other]
        if guests.any():  # a pair that also meets in the guest's home counts in the lower of both
            i, j = np.nonzero(s & (guests & (base[other] < cell))[None, :])
            pair, back = np.unique(left[i].astype(np.int64) << 32 | base[other[j]], return_inverse=True)
            there = np.array([int(p & 0xFFFFFFFF) in cells[p >> 32] for p in pair.tolist()], bool)
            if len(pair):
                s[i[there[back]], j[there[back]]] = False
        count = np.zeros(len(cid), np.int64)
        count[left] += s @ size[other]
        apart = ~np.isin(other, left)
        count[other[apart]] += s[:, apart].T @ size[left]
        up = np.arange(len(cid))

        def root(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        for a, row in zip(left.tolist(), s, strict=True):
            hits = other[row]
            if len(hits):
                for b in np.unique(up[hits]).tolist():
                    p, q = root(a), root(b)
                    if p != q:
                        up[max(p, q)] = min(p, q)
        roots = np.array([root(v) for v in range(len(cid))], np.int64) if len(cid) else up
        use = (count > 0) | (roots != np.arange(len(cid)))
        return pa.table({"cid": pa.array(cid[use]), "n": pa.array(count[use]), "root": pa.array(cid[roots[use]])})

    met = scratch.keep(spread.groupBy("cell", "kind", "lo", "hi").applyInArrow(products, "cid bigint, n bigint, root bigint"), "met")
    counts = scratch.keep(met.groupBy("cid").agg(F.sum("n").alias("n")), "counts")
    comps = components(scratch, met.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    labels = classes.join(counts, "cid", "left").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    labels = scratch.keep(labels.select("raw", "size", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "cid").alias("component")), "labels")
    scratch.drop(placed, met, counts)
    out = rows.join(labels, "raw", "left")
    comp = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    n_links = F.when(F.col("vec_id").isNotNull(), F.coalesce(F.col("n") + F.col("size") - 1, F.lit(0))).otherwise(F.lit(0))
    return out.select("vec_id", n_links.cast("bigint").alias("n_links"), comp.alias("component_id"), (comp == F.col("vec_id")).alias("kept"))


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return link(vectors)


#: The same rows in DuckDB's SQL, all pairs compared; for tables whose vectors are all usable.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
c AS (SELECT u, least(u, min(v)) AS c FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept FROM v LEFT JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id
"""
