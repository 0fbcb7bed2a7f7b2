"""Neighbour search: a periodic range join made an equi-join on cells of a grid.

Every atom falls into a grid cell no smaller than the cutoff; centres look into the distinct cells around theirs
(a grid of fewer than three cells along an axis has fewer), and the join's key is structure, frame and cell, so
all frames of all structures are searched in one shuffle. Only the nearest image of a pair counts: cutoffs above half
the smallest cell height see no further images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import CELL, KEY


def pair_cutoffs(cutoffs: dict[tuple[int, int], float], types: list[int]) -> list[tuple[int, int, float]]:
    """All ordered pairs of the types: given ones in both orders, the others at the largest given cutoff."""
    most = max(cutoffs.values())
    both = cutoffs | {(b, a): v for (a, b), v in cutoffs.items() if (b, a) not in cutoffs}
    return [(a, b, float(both.get((a, b), most))) for a in types for b in types]


def gridded(atoms: DataFrame, frames: DataFrame, cutoff: float) -> DataFrame:
    """Atoms with fractional coordinates f0..f2, their grid cell g0..g2 and the grid's shape n0..n2."""
    grid = frames.select(*KEY, *CELL, *(v.alias(k) for k, v in G.inverse().items()), *(F.greatest(F.floor(h / cutoff), F.lit(1)).cast("int").alias(f"n{k}") for k, h in enumerate(G.heights())))
    df = atoms.join(grid, KEY)
    f = G.fractional(F.col("x"), F.col("y"), F.col("z"))
    df = df.withColumns({f"f{k}": G.wrapped(f[k]) for k in range(3)})
    return df.withColumns({f"g{k}": F.least(F.floor(F.col(f"f{k}") * F.col(f"n{k}")), F.col(f"n{k}") - 1).cast("int") for k in range(3)})


def around(k: int) -> Column:
    g, n = F.col(f"g{k}"), F.col(f"n{k}")
    return F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.pmod(g + o, n))))


def pairs(
    atoms: DataFrame,
    frames: DataFrame,
    cutoff: float | dict[tuple[int, int], float],
    centers: list[int] | None = None,
    neighbors: list[int] | None = None,
    half: bool = False,
) -> DataFrame:
    """structure_id, frame, i, j, zi, zj, dx, dy, dz, d2 of every ordered pair within the cutoff (inclusive).

    The vector leads from i to j. A dict gives cutoffs by pair of atomic numbers in either order; pairs that it
    lacks get its largest. half: each pair once, i < j. Atoms without a frame row are left out.
    """
    most = float(cutoff) if not isinstance(cutoff, dict) else float(max(cutoff.values()))
    df = gridded(atoms, frames, most)
    a = df if centers is None else df.where(F.col("atomic_number").isin(centers))
    b = df if neighbors is None else df.where(F.col("atomic_number").isin(neighbors))
    left = a.select(*KEY, F.col("atom_id").alias("i"), F.col("atomic_number").alias("zi"), *CELL, *(F.col(f"f{k}").alias(f"a{k}") for k in range(3)), *(f"g{k}" for k in range(3)), *(f"n{k}" for k in range(3)))
    for k in range(3):
        left = left.withColumn(f"h{k}", around(k))
    left = left.drop("g0", "g1", "g2", "n0", "n1", "n2")
    right = b.select(*KEY, F.col("atom_id").alias("j"), F.col("atomic_number").alias("zj"), *(F.col(f"f{k}").alias(f"b{k}") for k in range(3)), *(F.col(f"g{k}").alias(f"h{k}") for k in range(3)))
    met = left.join(right, [*KEY, "h0", "h1", "h2"]).where("i < j" if half else "i <> j")
    d = G.cartesian([G.nearest(F.col(f"b{k}") - F.col(f"a{k}")) for k in range(3)])
    met = met.withColumns({"dx": d[0], "dy": d[1], "dz": d[2]})
    met = met.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    met = met.where(F.col("d2") <= most * most)
    if isinstance(cutoff, dict):
        rows = [f"({p}, {q}, {v!r}D)" for (p, q), v in (cutoff | {(q, p): v for (p, q), v in cutoff.items()}).items()]
        table = atoms.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(zi, zj, rc)")  # one row a pair of elements
        met = met.join(F.broadcast(table), ["zi", "zj"], "left").where(F.col("d2") <= F.pow(F.coalesce("rc", F.lit(most)), F.lit(2.0)))
    return met.select(*KEY, "i", "j", "zi", "zj", "dx", "dy", "dz", "d2")


def lists(atoms: DataFrame, found: DataFrame, vectors: bool = False) -> DataFrame:
    """One row for every atom with the ascending ids of its neighbours (empty if none), and the vectors to them."""
    item = F.struct("j", "dx", "dy", "dz")
    got = found.groupBy(*KEY, F.col("i").alias("atom_id")).agg(F.array_sort(F.collect_list(item)).alias("_n"))
    out = atoms.select(*KEY, "atom_id").join(got, [*KEY, "atom_id"], "left")
    cols = [F.coalesce(F.transform("_n", lambda n: n["j"]), F.array().cast("array<bigint>")).alias("neighbors")]
    if vectors:
        cols.append(F.coalesce(F.transform("_n", lambda n: F.array(n["dx"], n["dy"], n["dz"])), F.array().cast("array<array<double>>")).alias("vectors"))
    return out.select(*KEY, "atom_id", *cols)


def too_close(candidates: DataFrame, atoms: DataFrame, frames: DataFrame, least: float) -> DataFrame:
    """Candidates (atom-like rows) that keep the least distance from all atoms of their structure and frame."""
    grid_a, grid_b = gridded(candidates, frames, least), gridded(atoms, frames, least)
    left = grid_a.select("*")
    for k in range(3):
        left = left.withColumn(f"h{k}", around(k))
    right = grid_b.select(*KEY, *(F.col(f"f{k}").alias(f"b{k}") for k in range(3)), *(F.col(f"g{k}").alias(f"h{k}") for k in range(3)))
    met = left.join(right, [*KEY, "h0", "h1", "h2"])
    d = G.cartesian([G.nearest(F.col(f"b{k}") - F.col(f"f{k}")) for k in range(3)])
    near = met.where(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < least * least).select(*KEY, "atom_id").distinct()
    return candidates.join(near, [*KEY, "atom_id"], "left_anti")
