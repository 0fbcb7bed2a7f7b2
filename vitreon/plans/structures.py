"""Queries over pseudo-atoms: vectors become atoms of one structure per label in cubes of 10 angstrom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import NEUTRON_B, XRAY_TERMS
from ..functions import lookup as L
from ..operators import angles as A
from ..operators import graph, neighbors, placement, structure, voxels
from ..schemas import CELL, KEY
from ..scratch import Stored
from ..sources import dumps, trajectories
from ..streaming.jobs import folder

BOX, CUTOFF = 10.0, 3.0
O, SI, NA = 8, 14, 11
FORMERS = [SI]


def atoms(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = lambda i: F.pmod((F.col("embedding")[i].cast("double") + 1.0) * 50.0, F.lit(BOX))
    z = F.when(F.col("vec_id") % 5 == 2, SI).when(F.col("vec_id") % 5 == 4, NA).otherwise(O)
    return e.select(F.col("label").cast("string").alias("structure_id"), F.lit(0).alias("frame"), F.col("vec_id").alias("atom_id"), z.alias("atomic_number"), v(0).alias("x"), v(1).alias("y"), v(2).alias("z"))


def frames(a: DataFrame) -> DataFrame:
    cell = {c: F.lit(BOX if c[1] == c[2] else 0.0) for c in CELL}
    return a.select(*KEY).distinct().withColumns(cell)


ATOMS = f"""a AS (SELECT CAST(label AS VARCHAR) AS structure_id, vec_id AS id, CASE vec_id % 5 WHEN 2 THEN {SI} WHEN 4 THEN {NA} ELSE {O} END AS zn,
  ((CAST(embedding[1] AS DOUBLE) + 1) * 50) % {BOX} AS x, ((CAST(embedding[2] AS DOUBLE) + 1) * 50) % {BOX} AS y, ((CAST(embedding[3] AS DOUBLE) + 1) * 50) % {BOX} AS z FROM embeddings)"""


def _pairs_sql(r: float) -> str:
    d = lambda c: f"((b.{c} - a.{c}) - {BOX} * round_even((b.{c} - a.{c}) / {BOX}, 0))"
    return f"""{ATOMS}, v AS (SELECT a.structure_id, a.id AS i, b.id AS j, a.zn AS zi, b.zn AS zj, {d('x')} AS dx, {d('y')} AS dy, {d('z')} AS dz
  FROM a JOIN a AS b ON a.structure_id = b.structure_id AND a.id <> b.id),
p AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM v WHERE dx * dx + dy * dy + dz * dz <= {r * r})"""


def _found(spark: SparkSession, d: str, r: float = CUTOFF) -> tuple[DataFrame, DataFrame]:
    a = atoms(spark, d)
    return a, neighbors.pairs(a, frames(a), r)


def coordination(spark: SparkSession, d: str) -> DataFrame:
    a, p = _found(spark, d)
    return structure.histogram(structure.coordination(a, p, SI), "cn", ["structure_id"])


COORDINATION = f"""WITH {_pairs_sql(CUTOFF)}, c AS (SELECT a.structure_id, a.id, count(p.j) AS cn FROM a LEFT JOIN p ON p.structure_id = a.structure_id AND p.i = a.id WHERE a.zn = {SI} GROUP BY ALL)
SELECT structure_id, cn, count(*) AS n FROM c GROUP BY ALL"""

_RC = {(O, SI): 3.0, (O, NA): 2.5, (O, O): 2.0}


def pair_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    a = atoms(spark, d)
    return neighbors.pairs(a, frames(a), _RC).groupBy("structure_id", "zi", "zj").agg(F.count("*").alias("n"), F.round(F.sum("d2"), 6).alias("sum_d2"))


PAIR_CUTOFFS = f"""WITH {_pairs_sql(3.0)} SELECT structure_id, zi, zj, count(*) AS n, round(sum(d2), 6) AS sum_d2 FROM p
WHERE d2 <= CASE WHEN zi = {O} AND zj = {O} THEN 4.0 WHEN (zi, zj) IN (({O}, {NA}), ({NA}, {O})) THEN 6.25 ELSE 9.0 END GROUP BY ALL"""


def lists(spark: SparkSession, d: str) -> DataFrame:
    a = atoms(spark, d)
    p = neighbors.pairs(a, frames(a), CUTOFF, centers=[SI], neighbors=[O])
    return neighbors.lists(a, p).select("structure_id", "atom_id", F.concat_ws(",", F.transform("neighbors", lambda x: x.cast("string"))).alias("neighbors"))


LISTS = f"""WITH {_pairs_sql(CUTOFF)} SELECT a.structure_id, a.id AS atom_id, coalesce(string_agg(CAST(p.j AS VARCHAR), ',' ORDER BY p.j), '') AS neighbors
FROM a LEFT JOIN p ON p.structure_id = a.structure_id AND p.i = a.id AND p.zi = {SI} AND p.zj = {O} GROUP BY ALL"""

_RMAX, _BINS = 5.0, 50


def _g(spark: SparkSession, d: str) -> DataFrame:
    a = atoms(spark, d)
    return structure.rdf(a, frames(a), _RMAX, _BINS)


def rdf(spark: SparkSession, d: str) -> DataFrame:
    return _g(spark, d).where("za <= zb").select("structure_id", "za", "zb", "bin", F.col("count").alias("pairs"), F.round("g", 6).alias("g"))


def cumulative(spark: SparkSession, d: str) -> DataFrame:
    return _g(spark, d).select("structure_id", "za", "zb", "bin", F.round("n", 6).alias("n"))


_GRID = f"""{_pairs_sql(_RMAX)}, k AS (SELECT structure_id, zn, count(*) AS cnt FROM a GROUP BY ALL),
h AS (SELECT structure_id, zi, zj, CAST(least(floor(sqrt(d2) / {_RMAX / _BINS}), {_BINS - 1}) AS INT) AS bin, count(*) AS h FROM p WHERE i < j GROUP BY ALL),
hh AS (SELECT structure_id, least(zi, zj) AS lo, greatest(zi, zj) AS hi, bin, sum(h) AS h FROM h GROUP BY ALL),
g AS (SELECT s.structure_id, s.zn AS za, t.zn AS zb, s.cnt AS na, t.cnt AS nb, CAST(b.range AS INT) AS bin, CAST(coalesce(hh.h, 0) AS BIGINT) AS h, (b.range + 0.5) * {_RMAX / _BINS} AS r
  FROM k AS s JOIN k AS t ON s.structure_id = t.structure_id CROSS JOIN range({_BINS}) AS b
  LEFT JOIN hh ON hh.structure_id = s.structure_id AND hh.lo = least(s.zn, t.zn) AND hh.hi = greatest(s.zn, t.zn) AND hh.bin = b.range),
gr AS (SELECT *, CASE WHEN za = zb THEN 2.0 * h / (na * ((nb - 1) / {BOX**3}) * (4 * pi() * r * r * {_RMAX / _BINS}) + 1e-10)
  ELSE h / (na * (nb / {BOX**3}) * (4 * pi() * r * r * {_RMAX / _BINS}) + 1e-10) END AS g FROM g)"""
RDF = f"WITH {_GRID} SELECT structure_id, za, zb, bin, h AS pairs, round(g, 6) AS g FROM gr WHERE za <= zb"
CUMULATIVE = f"""WITH {_GRID} SELECT structure_id, za, zb, bin, round(sum(h * CASE WHEN za = zb THEN 2 ELSE 1 END)
  OVER (PARTITION BY structure_id, za, zb ORDER BY bin ROWS UNBOUNDED PRECEDING) / na, 6) AS n FROM gr"""


def structure_factor(spark: SparkSession, d: str) -> DataFrame:
    s = structure.structure_factor(_g(spark, d), 0.5, 10.0, 20)
    return s.select("structure_id", F.coalesce("za", F.lit(0)).alias("za"), F.coalesce("zb", F.lit(0)).alias("zb"), "k", F.round("q", 6).alias("q"), F.round("s", 5).alias("s"))


_LAST = (_BINS - 0.5) * (_RMAX / _BINS)
STRUCTURE_FACTOR = f"""WITH {_GRID}, q AS (SELECT CAST(range AS INT) AS k, 0.5 + range * {9.5 / 19!r} AS q FROM range(20)), nn AS (SELECT structure_id, count(*) AS n_all FROM a GROUP BY ALL),
t AS (SELECT gr.structure_id, za, zb, na, nb, k, q, sum(r * (g - 1) * sin(pi() * r / {_LAST!r}) / (pi() * r / {_LAST!r}) * sin(q * r) * CASE WHEN bin IN (0, {_BINS - 1}) THEN 0.5 ELSE 1 END * {_RMAX / _BINS}) AS t
  FROM gr CROSS JOIN q WHERE za <= zb GROUP BY ALL),
s AS (SELECT t.*, n_all, 1 + 4 * pi() * (n_all / {BOX**3}) / q * t AS s, CASE za WHEN {O} THEN 5.803 WHEN {SI} THEN 4.1491 ELSE 3.63 END AS ba, CASE zb WHEN {O} THEN 5.803 WHEN {SI} THEN 4.1491 ELSE 3.63 END AS bb
  FROM t JOIN nn ON t.structure_id = nn.structure_id)
SELECT structure_id, za, zb, k, round(q, 6) AS q, round(s, 5) AS s FROM s UNION ALL
SELECT structure_id, 0, 0, k, round(q, 6), round(1 + sum(CASE WHEN za = zb THEN 1 ELSE 2 END * (na / n_all) * (nb / n_all) * ba * bb * (s - 1)) / pow(sum(CASE WHEN za = zb THEN na / n_all * ba ELSE 0 END), 2), 5)
FROM s GROUP BY structure_id, k, q"""


def rdf_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    """g(r) of silicon with oxygen and with itself only."""
    a = atoms(spark, d)
    g = structure.rdf(a, frames(a), _RMAX, _BINS, [(SI, O), (SI, SI)])
    return g.select("structure_id", "za", "zb", "bin", F.round("g", 6).alias("g"), F.round("n", 6).alias("n"))


RDF_OF_PAIRS = f"""WITH {_GRID} SELECT structure_id, za, zb, bin, round(g, 6) AS g, round(sum(h * CASE WHEN za = zb THEN 2 ELSE 1 END) OVER (PARTITION BY structure_id, za, zb ORDER BY bin ROWS UNBOUNDED PRECEDING) / na, 6) AS n
FROM gr WHERE (za, zb) IN (({SI}, {O}), ({O}, {SI}), ({SI}, {SI}))"""


def angles(spark: SparkSession, d: str) -> DataFrame:
    a = atoms(spark, d)
    return A.angles_within(a, frames(a), CUTOFF, SI, O, 36).select("structure_id", "bin", F.col("count").alias("n"), F.round("density", 8).alias("density"))


ANGLES = f"""WITH {_pairs_sql(CUTOFF)}, c AS (SELECT s.structure_id, CAST(least(floor(degrees(acos(greatest(-1, least(1, (s.dx / sqrt(s.d2)) * (t.dx / sqrt(t.d2)) + (s.dy / sqrt(s.d2)) * (t.dy / sqrt(t.d2)) + (s.dz / sqrt(s.d2)) * (t.dz / sqrt(t.d2)))))) / 5.0), 35) AS INT) AS bin
  FROM p AS s JOIN p AS t ON s.structure_id = t.structure_id AND s.i = t.i AND s.j < t.j WHERE s.zi = {SI} AND s.zj = {O} AND t.zj = {O})
SELECT structure_id, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY structure_id) * 5.0), 8) AS density FROM c GROUP BY structure_id, bin"""


def oxygens(spark: SparkSession, d: str) -> DataFrame:
    a, p = _found(spark, d)
    return structure.oxygen_classes(a, p, FORMERS).groupBy("structure_id", "o_class").agg(F.count("*").alias("n"))


_O = f"""oc AS (SELECT a.structure_id, a.id, count(p.j) AS k FROM a LEFT JOIN p ON p.structure_id = a.structure_id AND p.i = a.id AND p.zj = {SI} WHERE a.zn = {O} GROUP BY ALL)"""
OXYGENS = f"WITH {_pairs_sql(CUTOFF)}, {_O} SELECT structure_id, CASE k WHEN 0 THEN 'free' WHEN 1 THEN 'NBO' WHEN 2 THEN 'BO' ELSE 'tri' END AS o_class, count(*) AS n FROM oc GROUP BY ALL"


def qn(spark: SparkSession, d: str) -> DataFrame:
    a, p = _found(spark, d)
    return structure.qn(a, p, FORMERS).where("z is null").select("structure_id", "n", F.col("count").alias("formers"))


_Q = f"""{_O}, f AS (SELECT a.structure_id, a.id, count(oc.id) AS n FROM a LEFT JOIN p ON p.structure_id = a.structure_id AND p.i = a.id AND p.zj = {O}
  LEFT JOIN oc ON oc.structure_id = p.structure_id AND oc.id = p.j AND oc.k >= 2 WHERE a.zn = {SI} GROUP BY ALL)"""
QN = f"""WITH {_pairs_sql(CUTOFF)}, {_Q}, c AS (SELECT structure_id, n, count(*) AS c FROM f GROUP BY ALL), s AS (SELECT structure_id, greatest(max(n), 6) AS top FROM f GROUP BY ALL),
g AS (SELECT structure_id, unnest(range(top + 1)) AS n FROM s)
SELECT g.structure_id, g.n, coalesce(c.c, 0) AS formers FROM g LEFT JOIN c ON c.structure_id = g.structure_id AND c.n = g.n"""


def connectivity(spark: SparkSession, d: str) -> DataFrame:
    a, p = _found(spark, d)
    return structure.connectivity(structure.qn(a, p, FORMERS)).select("structure_id", F.round("connectivity", 6).alias("connectivity"))


CONNECTIVITY = f"WITH {_pairs_sql(CUTOFF)}, {_Q} SELECT structure_id, round(avg(n), 6) AS connectivity FROM f GROUP BY ALL"


def _edges(spark: SparkSession, d: str, r: float) -> DataFrame:
    """Edges of silicon and sodium; pairs of crowded structures aren't listed."""
    a = atoms(spark, d)
    p, dense = graph.apart(a, frames(a), r, [SI, NA])
    return graph.former_edges(p, [SI, NA], O, dense)


def edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d, 4.0).select("structure_id", "u", "v")


_E = f"""e AS (SELECT DISTINCT s.structure_id, s.j AS u, t.j AS v FROM p AS s JOIN p AS t ON s.structure_id = t.structure_id AND s.i = t.i AND s.j < t.j
  WHERE s.zi = {O} AND s.zj IN ({SI}, {NA}) AND t.zj IN ({SI}, {NA}))"""
EDGES = f"WITH {_pairs_sql(4.0)}, {_E} SELECT structure_id, u, v FROM e"


def triangles(spark: SparkSession, d: str) -> DataFrame:
    return graph.triangle_numbers(_edges(spark, d, 4.0)).select("structure_id", F.col("n").alias("rings"))


TRIANGLES = f"""WITH {_pairs_sql(4.0)}, {_E} SELECT x.structure_id, count(*) AS rings FROM e AS x JOIN e AS y ON x.structure_id = y.structure_id AND x.v = y.u
JOIN e AS z ON z.structure_id = x.structure_id AND z.u = x.u AND z.v = y.v GROUP BY ALL"""


def rings(spark: SparkSession, d: str) -> DataFrame:
    return graph.ring_sizes(_edges(spark, d, 3.0)).select("structure_id", "size", "n")


# Distances to v without the edge, then all paths from u along which they fall.
RINGS = f"""WITH RECURSIVE {_pairs_sql(3.0)}, {_E}, b AS (SELECT structure_id, u AS x, v AS y FROM e UNION ALL SELECT structure_id, v, u FROM e),
w AS (SELECT structure_id, u, v, v AS x, 0 AS d FROM e UNION SELECT w.structure_id, w.u, w.v, b.y, d + 1 FROM w JOIN b ON b.structure_id = w.structure_id AND b.x = w.x
  WHERE d < 23 AND NOT (w.x = u AND b.y = v OR w.x = v AND b.y = u)),
m AS (SELECT structure_id, u, v, x, min(d) AS d FROM w GROUP BY ALL),
t AS (SELECT structure_id, u, v, [u] AS r, u AS x, d FROM m WHERE x = u AND d >= 2 UNION ALL SELECT t.structure_id, t.u, t.v, list_append(r, b.y), b.y, t.d - 1
  FROM t JOIN b ON b.structure_id = t.structure_id AND b.x = t.x AND NOT (b.x = t.u AND b.y = t.v OR b.x = t.v AND b.y = t.u) JOIN m ON m.structure_id = t.structure_id AND m.u = t.u AND m.v = t.v AND m.x = b.y AND m.d = t.d - 1),
o AS (SELECT structure_id, len(r) AS k, list_concat(r[list_position(r, list_min(r)):], r[:list_position(r, list_min(r)) - 1]) AS r FROM t WHERE d = 0)
SELECT structure_id, CAST(k AS INT) AS size, count(DISTINCT CASE WHEN r[2] < r[k] THEN r ELSE list_concat(r[:1], list_reverse(r[2:])) END) AS n FROM o GROUP BY structure_id, k"""


def ring_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges by the size of the smallest ring that each closes, and the shortest paths that close them."""
    c = graph.ring_totals(_edges(spark, d, 3.0))
    return c.select("structure_id", "size", "edges", F.col("paths").cast("bigint").alias("paths"))


RING_COUNTS = f"{RINGS[: RINGS.index(',' + chr(10) + 'o AS')]} SELECT structure_id, CAST(len(r) AS INT) AS size, count(DISTINCT (u, v)) AS edges, count(*) AS paths FROM t WHERE d = 0 GROUP BY ALL"


def cavities(spark: SparkSession, d: str) -> DataFrame:
    a = atoms(spark, d)
    return voxels.cavities(a, frames(a), {O: 1.52, SI: 2.1, NA: 2.27}, 32, keep_percolating=True).drop("frame")


def minima(spark: SparkSession, d: str) -> DataFrame:
    return structure.rdf_minima(_g(spark, d)).drop("frame")


def roles(spark: SparkSession, d: str) -> DataFrame:
    """Atoms with role and oxygen class, as a viewer shows them."""
    a, p = _found(spark, d)
    e = L.elements(spark).select("atomic_number", "symbol", "role")
    o = structure.oxygen_classes(a, p, FORMERS)
    return a.join(F.broadcast(e), "atomic_number").join(o, [*KEY, "atom_id"], "left").groupBy("structure_id", "symbol", "role", "o_class").agg(F.count("*").alias("n"))


ROLES = f"""WITH {_pairs_sql(CUTOFF)}, {_O} SELECT a.structure_id, CASE a.zn WHEN {O} THEN 'O' WHEN {SI} THEN 'Si' ELSE 'Na' END AS symbol, CASE a.zn WHEN {O} THEN 'oxygen' WHEN {SI} THEN 'former' ELSE 'modifier' END AS role,
CASE oc.k WHEN 0 THEN 'free' WHEN 1 THEN 'NBO' WHEN 2 THEN 'BO' ELSE CASE WHEN oc.k IS NULL THEN NULL ELSE 'tri' END END AS o_class, count(*) AS n
FROM a LEFT JOIN oc ON oc.structure_id = a.structure_id AND oc.id = a.id GROUP BY ALL"""


def density(spark: SparkSession, d: str) -> DataFrame:
    a = atoms(spark, d)
    return structure.number_density(a, frames(a)).select("structure_id", F.col("n").alias("atoms"), F.round("density", 9).alias("density"))


DENSITY = f"SELECT CAST(label AS VARCHAR) AS structure_id, count(*) AS atoms, round(count(*) / {BOX**3}, 9) AS density FROM embeddings GROUP BY ALL"


def free_space(spark: SparkSession, d: str) -> DataFrame:
    """Of the sodium atoms, those at least 1.6 angstrom from all others of their structure."""
    a = atoms(spark, d)
    na, rest = a.where(F.col("atomic_number") == NA), a.where(F.col("atomic_number") != NA)
    return neighbors.too_close(na, rest, frames(a), 1.6).select("structure_id", "atom_id")


FREE_SPACE = f"""WITH {_pairs_sql(1.7)} SELECT structure_id, id AS atom_id FROM a WHERE zn = {NA} AND NOT EXISTS (SELECT 1 FROM p WHERE p.structure_id = a.structure_id AND p.i = a.id AND p.zj <> {NA} AND p.d2 < 1.6 * 1.6)"""


def replicas(spark: SparkSession, d: str) -> DataFrame:
    a = atoms(spark, d).withColumn("box", F.lit(BOX))
    r = placement.replicate(a, "box", (2, 1, 2))
    return r.groupBy("structure_id").agg(F.count("*").alias("n"), F.max("atom_id").alias("last"), F.round(F.sum("x"), 3).alias("sum_x"), F.round(F.sum("z"), 3).alias("sum_z"))


REPLICAS = f"""WITH {ATOMS}, r AS (SELECT structure_id, round(x + i.range * {BOX}, 6) AS x, round(z + k.range * {BOX}, 6) AS z FROM a CROSS JOIN range(2) AS i CROSS JOIN range(2) AS k)
SELECT structure_id, count(*) AS n, count(*) AS last, round(sum(x), 3) AS sum_x, round(sum(z), 3) AS sum_z FROM r GROUP BY ALL"""


def random_structure(spark: SparkSession, d: str) -> DataFrame:
    """Atoms by element, and how many pairs of them are nearer than the least distance."""
    counts = atoms(spark, d).groupBy("structure_id", "atomic_number").agg(F.count("*").alias("atoms"))
    counts = counts.withColumn("element", F.when(F.col("atomic_number") == O, "O").when(F.col("atomic_number") == SI, "Si").otherwise("Na"))
    boxes = counts.groupBy("structure_id").agg((F.cbrt(F.sum("atoms") / 0.05)).alias("box"))
    made = placement.random_atoms(counts.select("structure_id", "element", "atoms"), boxes).withColumn("frame", F.lit(0))
    cells = boxes.select("structure_id", F.lit(0).alias("frame"), *((F.col("box") if c[1] == c[2] else F.lit(0.0)).alias(c) for c in CELL))
    near = neighbors.pairs(made.withColumn("atomic_number", F.lit(1)), cells, 1.6, half=True).where("d2 < 2.56 - 1e-9").groupBy("structure_id").agg(F.count("*").alias("near"))
    n = made.groupBy("structure_id", "element").agg(F.count("*").alias("n"), F.countDistinct("x", "y", "z").alias("places"))
    return n.join(near, "structure_id", "left").select("structure_id", "element", "n", "places", F.coalesce("near", F.lit(0)).alias("too_near"))


RANDOM = f"""WITH {ATOMS} SELECT structure_id, CASE zn WHEN {O} THEN 'O' WHEN {SI} THEN 'Si' ELSE 'Na' END AS element, count(*) AS n, count(*) AS places, 0 AS too_near FROM a GROUP BY ALL"""


def xyz(spark: SparkSession, d: str) -> DataFrame:
    """The texts themselves, of atoms on a grid of 1/64 so that eight places are exact."""
    a = _on_grid(atoms(spark, d))
    return trajectories.to_text(a, frames(a), "extxyz").select("structure_id", "text")


_FRAMES = 7


def dump_frames(spark: SparkSession, d: str) -> DataFrame:
    """Two frames of dumps that the atoms were written to, in seven frames a file: only their bytes are read."""
    a = _on_grid(atoms(spark, d)).withColumns({"frame": (F.col("atom_id") % _FRAMES).cast("int"), "type": F.col("atomic_number"), "element": F.when(F.col("atomic_number") == O, "O").when(F.col("atomic_number") == SI, "Si").otherwise("Na")})
    f = frames(a).withColumns({"step": F.col("frame") * 100, "file": F.concat(F.lit("run"), F.col("structure_id"), F.lit(".dump"))})
    where = folder(spark, "dumps")
    dumps.write_files(dumps.dump_texts(a, f, "file"), f"{where}/files")
    dumps.write_index(spark, f"{where}/files", f"{where}/index")
    got = dumps.read_frames(spark, f"{where}/index").where("frame in (2, 5)")
    name = F.regexp_extract("structure_id", r"run([^/]*)\.dump$", 1).alias("structure_id")
    return got.groupBy(name, "frame", "step", "element").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("z").alias("z"), F.min("atom_id").alias("first"), F.max(F.col("cell")[8]).alias("edge"))


DUMP_FRAMES = f"""WITH {ATOMS}, r AS (SELECT DENSE_RANK() OVER (PARTITION BY structure_id ORDER BY id % {_FRAMES}) - 1 AS k, * FROM a)
SELECT structure_id, CAST(k AS INT) AS frame, id % {_FRAMES} * 100 AS step, CASE zn WHEN {O} THEN 'O' WHEN {SI} THEN 'Si' ELSE 'Na' END AS element, count(*) AS n, sum(floor(x * 64) / 64) AS x, sum(floor(z * 64) / 64) AS z, min(id) AS first, 10.0::DOUBLE AS edge
FROM r WHERE k IN (2, 5) GROUP BY ALL"""


def histogram_files(spark: SparkSession, d: str) -> DataFrame:
    """Coordination and angles as files, one a structure, read back."""
    a, p = _found(spark, d)
    cn = structure.histogram(structure.coordination(a, p, SI), "cn", ["structure_id"])
    where = folder(spark, "histograms")
    dumps.write_files(dumps.histogram_texts(cn, "structure_id", "cn", "n", "Si"), where)
    ang = Stored(spark, "angles").keep(A.angles_within(a, frames(a), CUTOFF, SI, O, 6))  # counted once, whatever the writer reads
    dumps.write_files(dumps.angle_texts(ang, "structure_id", "bin", "density", [15.0 + 30 * k for k in range(6)]), where)
    raw = spark.read.text(where, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"), F.split("value", "\n").alias("l"))
    return raw.select("file", F.col("l")[0].alias("head"), F.col("l")[1].alias("line"))


HISTOGRAM_FILES = f"""WITH {_pairs_sql(CUTOFF)}, c AS (SELECT a.structure_id, a.id, count(p.j) AS cn FROM a LEFT JOIN p ON p.structure_id = a.structure_id AND p.i = a.id WHERE a.zn = {SI} GROUP BY ALL),
h AS (SELECT structure_id, cn, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT structure_id, unnest(range(max(cn) + 1)) AS k FROM h GROUP BY structure_id), t AS (SELECT m.structure_id, k, coalesce(n, 0) AS n FROM m LEFT JOIN h ON h.structure_id = m.structure_id AND cn = k),
s AS (SELECT s.structure_id, CAST(least(floor(degrees(acos(greatest(-1, least(1, (s.dx / sqrt(s.d2)) * (t.dx / sqrt(t.d2)) + (s.dy / sqrt(s.d2)) * (t.dy / sqrt(t.d2)) + (s.dz / sqrt(s.d2)) * (t.dz / sqrt(t.d2)))))) / 30.0), 5) AS INT) AS bin
  FROM p AS s JOIN p AS t ON s.structure_id = t.structure_id AND s.i = t.i AND s.j < t.j WHERE s.zi = {SI} AND s.zj = {O} AND t.zj = {O}),
g AS (SELECT structure_id, bin, count(*) / (sum(count(*)) OVER (PARTITION BY structure_id) * 30.0) AS v FROM s GROUP BY structure_id, bin), w AS (SELECT structure_id, b.range AS bin FROM (SELECT DISTINCT structure_id FROM g), range(6) AS b),
f AS (SELECT structure_id, string_agg(printf('%.6f', coalesce(v, 0)), ' ' ORDER BY bin) AS t FROM w LEFT JOIN g USING (structure_id, bin) GROUP BY structure_id)
SELECT structure_id || '.Si.txt' AS file, 'composition ' || string_agg('Si_' || k, ' ' ORDER BY k) || ' Si_tot' AS head, structure_id || ' ' || string_agg(n, ' ' ORDER BY k) || ' ' || sum(n) AS line FROM t GROUP BY structure_id
UNION ALL SELECT structure_id || '.angles.txt', 'composition 15.00 45.00 75.00 105.00 135.00 165.00', structure_id || ' ' || t FROM f"""


def _on_grid(a: DataFrame) -> DataFrame:
    return a.withColumns({c: F.floor(F.col(c) * 64) / 64 for c in "xyz"})


XYZ = f"""WITH {ATOMS}, l AS (SELECT structure_id, id, CASE zn WHEN {O} THEN 'O' WHEN {SI} THEN 'Si' ELSE 'Na' END || printf(' %.8f %.8f %.8f', floor(x * 64) / 64, floor(y * 64) / 64, floor(z * 64) / 64) AS t FROM a)
SELECT structure_id, count(*) || chr(10) || 'Lattice="{" ".join(f"{BOX if i == j else 0:.8f}" for i in range(3) for j in range(3))}" Properties=species:S:1:pos:R:3 pbc="T T T"' || chr(10) || string_agg(t, chr(10) ORDER BY id) AS text FROM l GROUP BY structure_id"""


def xray(spark: SparkSession, d: str) -> DataFrame:
    """Total S(q) for both radiations."""
    g = _g(spark, d)
    both = [structure.structure_factor(g, 0.5, 10.0, 20, radiation=x).where("za is null").select("structure_id", F.lit(x).alias("radiation"), "k", F.round("s", 5).alias("s")) for x in ("neutron", "xray")]
    return both[0].unionByName(both[1])


def _form_factor(z: str) -> str:
    s2 = "pow(q / (4 * pi()), 2)"
    terms = lambda n: " + ".join(f"{a!r} * exp(-{b!r} * {s2})" for a, b in zip(XRAY_TERMS[n][::2], XRAY_TERMS[n][1::2], strict=True))
    return f"CASE {z} " + " ".join(f"WHEN {n} THEN {n} - 41.78214 * {s2} * ({terms(n)})" for n in (O, SI, NA)) + " END"


def _length(z: str) -> str:
    return f"CASE {z} " + " ".join(f"WHEN {n} THEN {NEUTRON_B[n]!r}" for n in (O, SI, NA)) + " END"


XRAY = f"""WITH {_GRID}, q AS (SELECT CAST(range AS INT) AS k, 0.5 + range * {9.5 / 19!r} AS q FROM range(20)), nn AS (SELECT structure_id, count(*) AS n_all FROM a GROUP BY ALL),
t AS (SELECT gr.structure_id, za, zb, na, nb, k, q, sum(r * (g - 1) * sin(pi() * r / {_LAST!r}) / (pi() * r / {_LAST!r}) * sin(q * r) * CASE WHEN bin IN (0, {_BINS - 1}) THEN 0.5 ELSE 1 END * {_RMAX / _BINS}) AS t
  FROM gr CROSS JOIN q WHERE za <= zb GROUP BY ALL),
s AS (SELECT t.*, n_all, 4 * pi() * (n_all / {BOX**3}) / q * t AS s FROM t JOIN nn ON t.structure_id = nn.structure_id),
w AS (SELECT *, 'neutron' AS radiation, {_length('za')} AS ba, {_length('zb')} AS bb FROM s UNION ALL SELECT *, 'xray', {_form_factor('za')}, {_form_factor('zb')} FROM s)
SELECT structure_id, radiation, k, round(1 + sum(CASE WHEN za = zb THEN 1 ELSE 2 END * (na / n_all) * (nb / n_all) * ba * bb * s) / pow(sum(CASE WHEN za = zb THEN na / n_all * ba ELSE 0 END), 2), 5) AS s
FROM w GROUP BY structure_id, radiation, k"""


def small_rings(spark: SparkSession, d: str) -> DataFrame:
    """Rings of at most four nodes, which SQL can search as well."""
    return graph.ring_sizes(_edges(spark, d, 3.0), 4).select("structure_id", "size", "n")


SMALL_RINGS = f"""WITH {_pairs_sql(3.0)}, {_E}, b AS (SELECT structure_id, u, v FROM e UNION ALL SELECT structure_id, v, u FROM e),
t AS (SELECT DISTINCT x.structure_id, x.u, x.v, y.v AS w FROM e AS x JOIN b AS y ON y.structure_id = x.structure_id AND y.u = x.v JOIN b AS z ON z.structure_id = x.structure_id AND z.u = y.v AND z.v = x.u),
four AS (SELECT e.structure_id, [e.u, x.v, y.v, e.v] AS r FROM e JOIN b AS x ON x.structure_id = e.structure_id AND x.u = e.u AND x.v <> e.v
  JOIN b AS y ON y.structure_id = e.structure_id AND y.u = x.v AND y.v <> e.u JOIN b AS z ON z.structure_id = e.structure_id AND z.u = y.v AND z.v = e.v
  WHERE y.v <> e.v AND NOT EXISTS (SELECT 1 FROM t WHERE t.structure_id = e.structure_id AND t.u = e.u AND t.v = e.v)),
c AS (SELECT structure_id, r, list_position(r, list_min(r)) AS i FROM four)
SELECT structure_id, CAST(3 AS INT) AS size, count(DISTINCT list_sort([u, v, w])) AS n FROM t GROUP BY ALL UNION ALL
SELECT structure_id, CAST(4 AS INT), count(DISTINCT [list_min(r), r[(i + 1) % 4 + 1], least(r[i % 4 + 1], r[(i + 2) % 4 + 1]), greatest(r[i % 4 + 1], r[(i + 2) % 4 + 1])]) FROM c GROUP BY structure_id"""


QUERIES = {
    "neighbor_coordination": coordination, "neighbor_pair_cutoffs": pair_cutoffs, "neighbor_lists": lists, "rdf_partial": rdf, "cn_cumulative": cumulative,
    "structure_factor": structure_factor, "bond_angles": angles, "oxygen_classes": oxygens, "qn_distribution": qn, "network_connectivity": connectivity,
    "former_edges": edges, "rings_3": triangles, "rings": rings, "cavities": cavities, "rdf_minima": minima, "atom_roles": roles, "number_density": density,
    "min_distance": free_space, "replicate": replicas, "random_structure": random_structure, "structure_text": xyz, "structure_factor_total": xray, "rings_small": small_rings, "ring_counts": ring_counts,
    "rdf_of_pairs": rdf_of_pairs, "dump_frames": dump_frames, "histogram_files": histogram_files,
}
ORACLES = {
    "neighbor_coordination": COORDINATION, "neighbor_pair_cutoffs": PAIR_CUTOFFS, "neighbor_lists": LISTS, "rdf_partial": RDF, "cn_cumulative": CUMULATIVE,
    "structure_factor": STRUCTURE_FACTOR, "bond_angles": ANGLES, "oxygen_classes": OXYGENS, "qn_distribution": QN, "network_connectivity": CONNECTIVITY,
    "former_edges": EDGES, "rings_3": TRIANGLES, "atom_roles": ROLES, "number_density": DENSITY, "min_distance": FREE_SPACE, "replicate": REPLICAS,
    "random_structure": RANDOM, "structure_text": XYZ, "structure_factor_total": XRAY, "rings_small": SMALL_RINGS, "rings": RINGS, "ring_counts": RING_COUNTS,
    "rdf_of_pairs": RDF_OF_PAIRS, "dump_frames": DUMP_FRAMES, "histogram_files": HISTOGRAM_FILES,
}


def analysis(spark: SparkSession, d: str) -> DataFrame:
    """The nested record of every structure, its maps as JSON."""
    from . import analyze

    a = atoms(spark, d)
    out = analyze.analyze(a, frames(a), 5.0, 100, 36)
    maps = ["elements", "cutoffs", "coordination", "oxygen", "qn", "angles", "rings", "g", "cumulative", "sq_partial"]
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 6)).alias(c)
    return out.select("structure_id", "n_atoms", F.round("density", 9).alias("density"), F.round("connectivity", 6).alias("connectivity"), *(F.to_json(m).alias(m) for m in maps), *map(rounded, ("r", "q", "sq_neutron", "sq_xray")))


QUERIES["structural_analysis"] = analysis
