"""Queries over compositions: the deliveries of every supplier as a glass, and the parts of every order as mixtures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import lookup as L
from ..operators import composition as K
from ..operators import neighbors, series
from ..operators import potentials as P
from ..schemas import JOBS
from . import submit

#: What the parts of a supplier stand for: three of these, chosen by supplier, and silica.
OXIDES = ["Na2O", "CaO", "Al2O3", "B2O3", "MgO", "K2O", "Li2O", "PbO", "SrO", "ZnO"]


def glasses(spark: SparkSession, d: str, good: bool = True) -> DataFrame:
    """comp_id, pos, oxide, amount: a glass for every supplier, in percent of the quantities that it delivered.

    Of every seven suppliers' glasses four are faulty, by their sum, a sign, an element, or a charge; good leaves these out.
    """
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    q = li.groupBy(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 4).cast("int").alias("pos")).agg(F.sum("l_quantity").cast("double").alias("q"))
    amount = F.floor(10_000 * F.col("q") / F.sum("q").over(W.partitionBy("s"))) / 100
    odd, first = F.col("s") % 7, F.col("pos") == 0
    fine = F.when(F.col("pos") == 3, "SiO2").otherwise(F.get(F.array(*map(F.lit, OXIDES)), ((F.col("s") * 3 + F.col("pos")) % len(OXIDES)).cast("int")))
    oxide = F.when((odd == 5) & first, "Xx2O").when((odd == 6) & first, "NaO3").otherwise(fine)
    amount = F.when((odd == 4) & first, -amount).when(odd == 3, amount * 0.75).otherwise(amount)
    df = q.select("s", F.concat(F.when(odd < 3, "g").otherwise("bad"), F.col("s").cast("string")).alias("comp_id"), "pos", oxide.alias("oxide"), amount.alias("amount"))
    return (df.where("s % 7 < 3") if good else df).drop("s")


G = f"""q0 AS (SELECT l_suppkey AS s, CAST(l_partkey % 4 AS INT) AS pos, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY ALL), q1 AS (SELECT *, floor(10000 * q / sum(q) OVER (PARTITION BY s)) / 100 AS a FROM q0),
g AS (SELECT CASE WHEN s % 7 < 3 THEN 'g' ELSE 'bad' END || s AS comp_id, pos, CASE WHEN s % 7 = 5 AND pos = 0 THEN 'Xx2O' WHEN s % 7 = 6 AND pos = 0 THEN 'NaO3' WHEN pos = 3 THEN 'SiO2' ELSE ({OXIDES!r})[(s * 3 + pos) % {len(OXIDES)} + 1] END AS oxide,
  CASE WHEN s % 7 = 4 AND pos = 0 THEN -a WHEN s % 7 = 3 THEN a * 0.75 ELSE a END AS amount FROM q1)"""
OK = f"{G}, ok AS (SELECT *, amount / sum(amount) OVER (PARTITION BY comp_id) AS fraction FROM g WHERE comp_id NOT LIKE 'bad%')"
PARSE = """ox AS (SELECT DISTINCT oxide FROM g), px AS (SELECT oxide, unnest(regexp_extract_all(oxide, '([A-Z][a-z]*)(\\d*)', 1)) AS element, unnest(regexp_extract_all(oxide, '([A-Z][a-z]*)(\\d*)', 2)) AS n FROM ox),
el AS (SELECT oxide, element, CAST(sum(CAST(coalesce(nullif(n, ''), '1') AS BIGINT)) AS BIGINT) AS cnt FROM px GROUP BY ALL)"""
_USED = sorted({e for o in OXIDES + ["SiO2"] for e in C.MASSES if e in re.findall("[A-Z][a-z]?", o)})
M = "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', {C.MASSES[e]!r}::DOUBLE)" for e in _USED) + ") AS t(element, mass))"
FM = "fm AS (SELECT oxide, sum(cnt * mass) AS mass FROM el JOIN m USING (element) GROUP BY ALL)"


def formula_parse(spark: SparkSession, d: str) -> DataFrame:
    return K.parse(glasses(spark, d, False).select(F.col("oxide").alias("formula")))


def formula_mass(spark: SparkSession, d: str) -> DataFrame:
    df = K.formula_mass(glasses(spark, d, False).select(F.col("oxide").alias("formula")))
    return df.select("formula", F.round("mass", 6).alias("mass"))


def check(spark: SparkSession, d: str) -> DataFrame:
    return K.check(glasses(spark, d, False)).select("comp_id", "status", F.round("total", 6).alias("total"))


_STATES = "st AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', {q})" for e in _USED for q in C.OXIDATION_STATES.get(e, ())) + ") AS t(element, charge))"
CHECK = f"""WITH {G}, {PARSE}, {_STATES}, known AS (SELECT oxide, bool_and(element IN (SELECT element FROM st)) AS known FROM el GROUP BY ALL),
two AS (SELECT DISTINCT a.oxide FROM el AS a JOIN el AS b ON a.oxide = b.oxide AND a.element < b.element JOIN st AS x ON x.element = a.element JOIN st AS y ON y.element = b.element WHERE a.cnt * x.charge + b.cnt * y.charge = 0),
t AS (SELECT comp_id, min(amount) AS least, sum(amount) AS total, bool_and(known) AS known, bool_and(g.oxide IN (SELECT oxide FROM two)) AS neutral FROM g JOIN known USING (oxide) GROUP BY ALL)
SELECT comp_id, CASE WHEN least < 0 THEN 'negative' WHEN NOT known THEN 'element' WHEN NOT neutral THEN 'neutral' WHEN abs(total - 1) > 0.001 AND abs(total - 100) > 0.1 THEN 'sum' ELSE 'ok' END AS status, round(total, 6) AS total FROM t"""


def weight_to_mol(spark: SparkSession, d: str) -> DataFrame:
    return K.weight_to_mol(glasses(spark, d)).select("comp_id", "oxide", F.round("fraction", 9).alias("fraction"))


WEIGHT = f"""WITH {OK}, {PARSE}, {M}, {FM}, w AS (SELECT comp_id, oxide, amount / mass AS x FROM ok JOIN fm USING (oxide))
SELECT comp_id, oxide, round(x / sum(x) OVER (PARTITION BY comp_id), 9) AS fraction FROM w"""


def elements(spark: SparkSession, d: str) -> DataFrame:
    return K.element_fractions(K.extract(glasses(spark, d, False)).withColumn("amount", F.col("fraction"))).select("comp_id", "element", F.round("fraction", 9).alias("fraction"))


_EF = f"{OK}, {PARSE}, e1 AS (SELECT comp_id, element, sum(fraction * cnt) AS atoms FROM ok JOIN el USING (oxide) GROUP BY ALL), ef AS (SELECT comp_id, element, atoms / sum(atoms) OVER (PARTITION BY comp_id) AS fraction FROM e1)"
ELEMENTS = f"WITH {_EF} SELECT comp_id, element, round(fraction, 9) AS fraction FROM ef"


def vector(spark: SparkSession, d: str) -> DataFrame:
    v = K.vectors(K.element_fractions(glasses(spark, d)))
    back = K.devector(v)
    return back.groupBy("comp_id").agg(F.count("*").alias("n"), F.round(F.sum("fraction"), 9).alias("total"), F.round(F.max("fraction"), 9).alias("most"))


VECTOR = f"WITH {_EF} SELECT comp_id, count(*) AS n, round(sum(fraction), 9) AS total, round(max(fraction), 9) AS most FROM ef GROUP BY ALL"


def distances(spark: SparkSession, d: str) -> DataFrame:
    """Between the glasses of suppliers whose lines follow each other in an order."""
    e = K.element_fractions(glasses(spark, d))
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.concat(F.lit("g"), F.col("l_suppkey").cast("string")).alias("g"), (F.col("l_suppkey") % 7).alias("odd")).where("odd < 3")
    other = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("g").alias("h"))
    pairs = li.join(other, ["l_orderkey", "l_linenumber"]).where("g <> h").select(F.least("g", "h").alias("id_a"), F.greatest("g", "h").alias("id_b")).distinct()
    return K.distance(e, e, pairs).select("id_a", "id_b", F.round("distance", 6).alias("distance"))


DISTANCES = f"""WITH {_EF}, li AS (SELECT l_orderkey AS o, l_linenumber AS n, 'g' || l_suppkey AS g FROM lineitem WHERE l_suppkey % 7 < 3),
pr AS (SELECT DISTINCT least(a.g, b.g) AS a, greatest(a.g, b.g) AS b FROM li AS a JOIN li AS b ON a.o = b.o AND b.n = a.n + 1 AND a.g <> b.g),
x AS (SELECT a, b, element, fraction AS f FROM pr JOIN ef ON comp_id = a UNION ALL SELECT a, b, element, -fraction FROM pr JOIN ef ON comp_id = b), y AS (SELECT a, b, element, sum(f) AS f FROM x GROUP BY ALL)
SELECT a AS id_a, b AS id_b, round(sqrt(sum(f * f)), 6) AS distance FROM y GROUP BY ALL"""


def density(spark: SparkSession, d: str) -> DataFrame:
    return K.density(K.extract(glasses(spark, d, False))).select("comp_id", F.round("density", 8).alias("density"))


def _density_sql() -> str:
    rows = []
    for k, v in C.DENSITY_TERMS.items():
        p = k.split("_")
        p = p[:-1] * int(p[-1]) if p[-1].isdigit() else p
        p += [""] * (3 - len(p))
        rows.append(f"({v!r}::DOUBLE, '{p[0]}', '{p[1]}', '{p[2]}')")
    c = lambda i: f"CASE t.p{i} WHEN '' THEN 1 ELSE (SELECT 100 * fraction FROM ok WHERE ok.comp_id = i.comp_id AND ok.oxide = t.p{i}) END"
    return f"""WITH {OK}, t AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(v, p1, p2, p3)), i AS (SELECT DISTINCT comp_id FROM ok),
s AS (SELECT i.comp_id, v * {c(1)} * {c(2)} * {c(3)} AS x FROM i CROSS JOIN t) SELECT comp_id, round({C.DENSITY_B0!r} + coalesce(sum(x), 0), 8) AS density FROM s GROUP BY ALL"""


def canonical(spark: SparkSession, d: str) -> DataFrame:
    c = K.canonical(glasses(spark, d))
    back = K.from_canonical(c).groupBy("comp_id").agg(F.round(F.sum("amount"), 6).alias("total"))
    return c.join(back, "comp_id")


CANONICAL = f"""WITH {OK}, s AS (SELECT comp_id, oxide, regexp_replace(regexp_replace(printf('%.2f', amount), '0+$', ''), '\\.$', '') AS a, amount FROM ok)
SELECT comp_id, string_agg(oxide || ' ' || a, ' - ' ORDER BY oxide) AS canonical, round(sum(CAST(a AS DOUBLE)), 6) AS total FROM s GROUP BY ALL"""


def fu_search(spark: SparkSession, d: str) -> DataFrame:
    p = K.plan(glasses(spark, d), 1000)
    return p.select("comp_id", "oxide", "units", "n_units", "n_atoms")


FU_SEARCH = f"""WITH {OK}, {PARSE}, au AS (SELECT oxide, sum(cnt) AS apu FROM el GROUP BY ALL), b AS (SELECT comp_id, pos, oxide, fraction, apu FROM ok JOIN au USING (oxide)),
q AS (SELECT comp_id, greatest(1, CAST(round_even(1000.0 / sum(fraction * apu), 0) AS BIGINT)) AS guess FROM b GROUP BY ALL),
n AS (SELECT comp_id, unnest(range(greatest(1, guess - 1000), guess + 1001)) AS n_units FROM q),
w AS (SELECT b.*, n_units, floor(fraction * n_units) AS f, row_number() OVER (PARTITION BY b.comp_id, n_units ORDER BY fraction * n_units - floor(fraction * n_units) DESC, pos) AS r,
  n_units - sum(floor(fraction * n_units)) OVER (PARTITION BY b.comp_id, n_units) AS rest FROM b JOIN n ON b.comp_id = n.comp_id),
u AS (SELECT *, CAST(f + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS units FROM w),
s AS (SELECT comp_id, n_units, CAST(sum(units * apu) AS BIGINT) AS n_atoms FROM u GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY comp_id ORDER BY abs(n_atoms - 1000), n_atoms, n_units) AS r FROM s)
SELECT u.comp_id, oxide, units, u.n_units, n_atoms FROM u JOIN k ON u.comp_id = k.comp_id AND u.n_units = k.n_units WHERE k.r = 1"""


def from_molecules(spark: SparkSession, d: str) -> DataFrame:
    p = K.plan(glasses(spark, d), 333, "molecules")
    return p.select("comp_id", "oxide", "units")


MOLECULES = f"""WITH {OK}, r AS (SELECT *, CAST(round_even(fraction * 333, 0) AS BIGINT) AS u, row_number() OVER (PARTITION BY comp_id ORDER BY fraction DESC, pos) AS k FROM ok)
SELECT comp_id, oxide, CAST(u + CASE WHEN k = 1 THEN 333 - sum(u) OVER (PARTITION BY comp_id) ELSE 0 END AS BIGINT) AS units FROM r"""


def box(spark: SparkSession, d: str) -> DataFrame:
    g = glasses(spark, d)
    units = K.plan(g, 333, "molecules")
    return K.box_length(units, K.density(K.extract(g))).select("comp_id", F.round("box", 6).alias("box"))


BOX = f"""WITH RECURSIVE dd AS ({_density_sql().replace('round(', '(').replace(', 8)', ')')}), u AS ({MOLECULES}), {G}, {PARSE}, {M}, {FM}
SELECT u.comp_id, round(cbrt(sum(units * mass) / {C.AVOGADRO!r} / any_value(density) * 1e24), 6) AS box FROM u JOIN fm USING (oxide) JOIN dd ON dd.comp_id = u.comp_id GROUP BY u.comp_id"""


def potentials(spark: SparkSession, d: str) -> DataFrame:
    e = K.element_fractions(glasses(spark, d)).select("comp_id", "element")
    return K.compatible(e).select("comp_id", F.concat_ws(",", "potentials").alias("potentials"), F.try_element_at("potentials", F.lit(1)).alias("best"))


_PE = "pe AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {i}, '{e}')" for i, p in enumerate(C.POTENTIAL_ORDER) for e in {"pmmcs": C.PMMCS, "shik": C.SHIK_CHARGES, "bjp": C.BJP_CHARGES}[p]) + ") AS t(potential, pref, element))"
POTENTIALS = f"""WITH {_EF}, {_PE}, n AS (SELECT comp_id, count(*) AS need FROM ef GROUP BY ALL),
h AS (SELECT comp_id, potential, pref FROM ef JOIN pe USING (element) JOIN n USING (comp_id) GROUP BY comp_id, potential, pref, need HAVING count(*) = need)
SELECT n.comp_id, coalesce(string_agg(potential, ',' ORDER BY pref), '') AS potentials, arg_min(potential, pref) AS best FROM n LEFT JOIN h ON h.comp_id = n.comp_id GROUP BY n.comp_id"""


def configs(spark: SparkSession, d: str) -> DataFrame:
    g = glasses(spark, d)
    e = K.element_fractions(g).select("comp_id", "element")
    counts = K.element_counts(K.plan(g, 333, "molecules"))
    df = None
    for p in C.POTENTIAL_ORDER:
        one = P.config(e, p, counts)
        df = one if df is None else df.unionByName(one)
    return df.select("comp_id", "name", F.concat_ws(" ", "species").alias("species"), F.concat_ws("\n", "config").alias("config"))


def config_lines(spark: SparkSession, d: str) -> DataFrame:
    """The inputs of the two potentials whose numbers are all fixed, line by line."""
    e = K.element_fractions(glasses(spark, d)).select("comp_id", "element")
    both = P.config(e, "pmmcs").unionByName(P.config(e, "bjp"))
    return both.select("comp_id", "name", F.posexplode("config").alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def _config_sql() -> str:
    one = ", ".join(f"('{e}', '{v[0]}', '{' '.join(map(str, (*v[1], v[2])))}')" for e, v in C.PMMCS.items())
    two = ", ".join(f"('{a}', '{b}', '{' '.join(f'{x:.6f}' for x in v)}')" for k, v in C.BJP.items() for a, b in [sorted(k)])
    charges = ", ".join(f"('{e}', '{v}')" for e, v in C.BJP_CHARGES.items())
    fixed = [("PMMCS", 4, "pair_style hybrid/overlay coul/dsf 0.25 8.0 pedone 5.5"), ("PMMCS", 4, "pair_coeff * * coul/dsf"), ("BJP", 4, "pair_style born/coul/dsf 0.25 8.0")]
    fixed += [(n, s, t) for n in ("PMMCS", "BJP") for s, t in ((0, "units metal"), (0, "dimension 3"), (0, "atom_style charge"), (6, "pair_modify shift yes"))]
    head = ", ".join(f"('{n}', {s}, '{t}')" for n, s, t in fixed)
    return f"""WITH {OK}, {PARSE}, x AS (SELECT DISTINCT comp_id, element FROM ok JOIN el USING (oxide)), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY comp_id ORDER BY element) AS INT) AS k FROM x),
a AS (SELECT * FROM (VALUES {one}) AS p(element, q, p)), b AS (SELECT * FROM (VALUES {two}) AS p(lo, hi, p)), c AS (SELECT * FROM (VALUES {charges}) AS p(element, q)),
w AS (SELECT s.comp_id, s.k AS ks, r.k AS kr, b.p FROM t AS s JOIN t AS r ON s.comp_id = r.comp_id AND s.k <= r.k LEFT JOIN b ON b.lo = s.element AND b.hi = r.element),
fit AS (SELECT 'PMMCS' AS name, comp_id FROM t LEFT JOIN a USING (element) GROUP BY comp_id HAVING bool_and(a.q IS NOT NULL) UNION ALL SELECT 'BJP', comp_id FROM w GROUP BY comp_id HAVING bool_and(p IS NOT NULL)),
l AS (SELECT fit.comp_id, fit.name, h.s, 0 AS i, 0 AS j, h.text FROM fit JOIN (VALUES {head}) AS h(name, s, text) ON h.name = fit.name
UNION ALL SELECT t.comp_id, fit.name, 1, k, 0, 'group ' || element || ' type ' || k FROM t JOIN fit ON fit.comp_id = t.comp_id
UNION ALL SELECT t.comp_id, 'PMMCS', 3, k, 0, 'set type ' || k || ' charge ' || q FROM t JOIN a USING (element) JOIN fit ON fit.comp_id = t.comp_id AND name = 'PMMCS'
UNION ALL SELECT t.comp_id, 'BJP', 3, k, 0, 'set type ' || k || ' charge ' || q FROM t JOIN c USING (element) JOIN fit ON fit.comp_id = t.comp_id AND name = 'BJP'
UNION ALL SELECT t.comp_id, 'PMMCS', 5, t.k, 0, 'pair_coeff ' || t.k || ' ' || o.k || ' pedone ' || a.p FROM t JOIN a USING (element) JOIN t AS o ON o.comp_id = t.comp_id AND o.element = 'O' JOIN fit ON fit.comp_id = t.comp_id AND name = 'PMMCS'
UNION ALL SELECT w.comp_id, 'BJP', 5, ks, kr, 'pair_coeff ' || ks || ' ' || kr || ' ' || p FROM w JOIN fit ON fit.comp_id = w.comp_id AND name = 'BJP')
SELECT comp_id, name, row_number() OVER (PARTITION BY comp_id, name ORDER BY s, i, j, text) - 1 AS line, text FROM l"""


CONFIG_LINES = _config_sql()


def charge(spark: SparkSession, d: str) -> DataFrame:
    counts = K.element_counts(K.plan(glasses(spark, d), 333, "molecules"))
    return K.oxygen_charge(counts).select("comp_id", F.round("charge", 9).alias("charge"))


_SQ = "q AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', {v!r}::DOUBLE)" for e, v in C.SHIK_CHARGES.items()) + ") AS t(element, q))"
CHARGE = f"""WITH u AS ({MOLECULES}), {G}, {PARSE}, {_SQ}, c AS (SELECT comp_id, element, sum(units * cnt) AS n FROM u JOIN el USING (oxide) GROUP BY ALL)
SELECT comp_id, round(-sum(CASE WHEN element <> 'O' THEN q * n ELSE 0 END) / sum(CASE WHEN element = 'O' THEN n ELSE 0 END), 9) AS charge FROM c LEFT JOIN q USING (element) GROUP BY ALL"""


def pair_energies(spark: SparkSession, d: str) -> DataFrame:
    """Energy and force of the silicon-oxygen potential, summed over the pairs of each structure by half angstroms."""
    from . import structures as S

    a = S.atoms(spark, d)
    r = F.sqrt("d2")
    v, f = P.energy_force(F.col("r"), *(F.lit(float(x)) for x in C.SHIK["O", "Si"]))
    p = neighbors.pairs(a, S.frames(a), 3.0, centers=[S.SI], neighbors=[S.O]).select("structure_id", r.alias("r")).where("r >= 1")
    return p.groupBy("structure_id", F.floor(F.col("r") * 2).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.sum(v), 5).alias("energy"), F.round(F.sum(f), 5).alias("force"))


_A, _B, _C, _D = C.SHIK["O", "Si"]


def _energies_sql() -> str:
    from . import structures as S

    return f"""WITH {S._pairs_sql(3.0)}, t AS (SELECT structure_id, sqrt(d2) AS r FROM p WHERE zi = {S.SI} AND zj = {S.O} AND sqrt(d2) >= 1)
SELECT structure_id, CAST(floor(r * 2) AS INT) AS bin, count(*) AS n, round(sum({_A} * exp(-{_B} * r) - {_C} / pow(r, 6) + {_D} / pow(r, 24)), 5) AS energy, round(sum({_A * _B!r} * exp(-{_B} * r) - 6 * {_C} / pow(r, 7) + 24 * {_D} / pow(r, 25)), 5) AS force FROM t GROUP BY ALL"""


def _schedules(spark: SparkSession, d: str) -> DataFrame:
    """A melt-quench schedule for every supplier."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(
        k.cast("string").alias("id"), F.get(F.array(*map(F.lit, C.POTENTIAL_ORDER)), (k % 3).cast("int")).alias("potential"), (3000.0 + k % 17 * 100).alias("t_high"), (300.0 + k % 5 * 10).alias("t_low"),
        (1e12 * (1 + k % 4)).alias("heating_rate"), (1e12 * (1 + k % 9)).alias("cooling_rate"), (1.0 + k % 2).alias("timestep"), F.when(k % 4 == 1, k % 11 * 1000).cast("bigint").alias("equilibration_steps"),
    )


def protocols(spark: SparkSession, d: str) -> DataFrame:
    return series.protocol(_schedules(spark, d), L.protocol_stages(spark)).select("id", "stage", "t_from", "t_to", "steps", "first_step", "p_from", "p_to")


def temperatures(spark: SparkSession, d: str) -> DataFrame:
    return series.temperature_program(protocols(spark, d).withColumn("potential", F.col("id")))


def _protocol_sql() -> str:
    stages = ", ".join(
        f"('{p}', {i + 1}, '{a}', '{b}', '{n if isinstance(n, str) else 'hold'}', {n if isinstance(n, int) else 'NULL'}, {p in C.PROTOCOL_FS}, {'NULL' if p0 is None else p0}::DOUBLE, {'NULL' if p1 is None else p1}::DOUBLE)"
        for p, rows in C.PROTOCOLS.items() for i, (a, b, n, p0, p1) in enumerate(rows)
    )
    return f"""SELECT id, stage, t_from, t_to, steps, CAST(sum(steps) OVER (PARTITION BY id ORDER BY stage) - steps AS BIGINT) AS first_step, p_from, p_to FROM (
  SELECT id, stage, CASE a WHEN 'high' THEN hi ELSE lo END AS t_from, CASE b WHEN 'high' THEN hi ELSE lo END AS t_to, p_from, p_to,
    CAST(CASE kind WHEN 'heating' THEN floor((hi - lo) / (dt * heat) * 1e15) WHEN 'cooling' THEN floor((hi - lo) / (dt * cool) * 1e15) ELSE coalesce(eq, CASE WHEN in_fs THEN floor(n / dt) ELSE n END) END AS BIGINT) AS steps
  FROM (SELECT CAST(s_suppkey AS VARCHAR) AS id, ({list(C.POTENTIAL_ORDER)!r})[s_suppkey % 3 + 1] AS potential, 3000.0::DOUBLE + s_suppkey % 17 * 100 AS hi, 300.0::DOUBLE + s_suppkey % 5 * 10 AS lo, 1e12::DOUBLE * (1 + s_suppkey % 4) AS heat,
    1e12::DOUBLE * (1 + s_suppkey % 9) AS cool, 1.0::DOUBLE + s_suppkey % 2 AS dt, CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey % 11 * 1000 END AS eq FROM supplier)
  JOIN (VALUES {stages}) AS t(potential, stage, a, b, kind, n, in_fs, p_from, p_to) USING (potential))"""


def choices(spark: SparkSession, d: str) -> DataFrame:
    g = glasses(spark, d)
    e = K.element_fractions(g).select("comp_id", "element")
    asked = g.select("comp_id").distinct().withColumn("potential", F.when(F.substring("comp_id", -1, 1).isin("1", "4"), F.lit("shik")).when(F.substring("comp_id", -1, 1) == "2", F.lit("bjp")))
    return K.choose_potential(asked, e)


CHOICES = f"""WITH {_EF}, {_PE}, n AS (SELECT comp_id, count(*) AS need, CASE WHEN right(comp_id, 1) IN ('1', '4') THEN 'shik' WHEN right(comp_id, 1) = '2' THEN 'bjp' END AS named FROM ef GROUP BY ALL),
h AS (SELECT comp_id, potential, pref FROM ef JOIN pe USING (element) JOIN n USING (comp_id) GROUP BY comp_id, potential, pref, need HAVING count(*) = need),
r AS (SELECT n.comp_id, coalesce(any_value(named), 'pmmcs') AS asked, coalesce(bool_or(h.potential = coalesce(named, 'pmmcs')), false) AS covers, arg_min(h.potential, pref) AS best FROM n LEFT JOIN h ON h.comp_id = n.comp_id GROUP BY n.comp_id),
c AS (SELECT comp_id, asked, CASE WHEN covers THEN asked WHEN asked = 'pmmcs' THEN best END AS chosen FROM r)
SELECT comp_id, chosen, CASE WHEN chosen IS NOT NULL THEN 'ok' WHEN asked = 'pmmcs' THEN 'none' ELSE 'unsupported' END AS status FROM c"""


def submission(spark: SparkSession, d: str) -> DataFrame:
    """Requests for all suppliers' glasses, after those of even suppliers have been submitted and finished: what becomes of each."""
    g = glasses(spark, d, False)
    ask = g.select("comp_id").distinct().select("comp_id", F.lit(None).cast("string").alias("potential"), F.lit(None).cast("double").alias("density"), F.lit(None).cast("map<string,string>").alias("settings"), F.array(F.lit("all")).alias("tags"))
    first = submit.submit(ask.where("cast(regexp_extract(comp_id, '[0-9]+', 0) as bigint) % 2 = 0"), g, spark.createDataFrame([], JOBS), "one")
    done = first.where("error is null").select("job_id", "request_hash", F.lit("completed").alias("status"), F.lit("{}").alias("result_data"), "tags", F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    got = submit.submit(ask, g, done, "two")
    return got.select("comp_id", "error", "composition", "potential", F.round("density", 6).alias("density"), "status", "hit", F.size("tags").alias("n_tags"))


def _submission_sql() -> str:
    # the same SQL as of the parts, with the wider tolerance of requests
    check = CHECK.replace("> 0.001", "> 0.03").replace("> 0.1", "> 3.0")
    canonical = CANONICAL.replace("printf('%.2f', amount)", "printf('%.2f', 100 * fraction)")
    choices = CHOICES.replace("'shik' WHEN right", "NULL WHEN right").replace("'2' THEN 'bjp'", "'2' THEN NULL")
    return f"""WITH k AS ({check}), n AS (SELECT comp_id, canonical FROM ({canonical})), p AS ({choices}), y AS ({_density_sql().replace(", 8) AS density", ", 6) AS density")}),
r AS (SELECT k.comp_id, CASE WHEN k.status <> 'ok' THEN 'composition: ' || k.status WHEN p.status <> 'ok' THEN 'potential: ' || p.status WHEN density IS NULL THEN 'density: unknown to the model' END AS error, canonical, chosen, density
  FROM k LEFT JOIN n USING (comp_id) LEFT JOIN p USING (comp_id) LEFT JOIN y USING (comp_id))
SELECT comp_id, error, canonical AS composition, chosen AS potential, density, CASE WHEN error IS NULL THEN CASE WHEN CAST(regexp_extract(comp_id, '[0-9]+') AS BIGINT) % 2 = 0 THEN 'completed' ELSE 'pending' END END AS status,
error IS NULL AND CAST(regexp_extract(comp_id, '[0-9]+') AS BIGINT) % 2 = 0 AS hit, 1 AS n_tags FROM r"""


def actual(spark: SparkSession, d: str) -> DataFrame:
    return K.actual_composition(K.element_counts(K.plan(glasses(spark, d), 333, "molecules")))


ACTUAL = f"""WITH u AS ({MOLECULES}), {G}, {PARSE}, c AS (SELECT comp_id, element, CAST(sum(units * cnt) AS BIGINT) AS n FROM u JOIN el USING (oxide) GROUP BY ALL)
SELECT comp_id, CAST(sum(n) AS BIGINT) AS atoms, string_agg(element || ' ' || n, ', ' ORDER BY element) AS text FROM c GROUP BY ALL"""


# --- mixtures of orders -----------------------------------------------------------------------------------


def _mixtures(spark: SparkSession, d: str) -> DataFrame:
    li, part = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/part.parquet")
    return li.join(part, li["l_partkey"] == part["p_partkey"]).groupBy(F.col("l_orderkey").alias("comp_id"), F.col("p_type").alias("kind")).agg(F.sum("l_quantity").alias("amount"))


def shares(spark: SparkSession, d: str) -> DataFrame:
    df = _mixtures(spark, d).withColumn("fraction", K.share(F.col("amount"), "comp_id"))
    return df.select("comp_id", "kind", F.round("fraction", 9).alias("fraction"))


_MIX = "x AS (SELECT l_orderkey AS comp_id, p_type AS kind, sum(l_quantity) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
SHARES = f"WITH {_MIX} SELECT comp_id, kind, round(amount / sum(amount) OVER (PARTITION BY comp_id), 9) AS fraction FROM x"


def remainders(spark: SparkSession, d: str) -> DataFrame:
    df = _mixtures(spark, d).withColumn("fraction", K.share(F.col("amount"), "comp_id"))
    return K.largest_remainder(df, "comp_id", "fraction", F.lit(100), "kind").select("comp_id", "kind", "units")


REMAINDERS = f"""WITH {_MIX}, f AS (SELECT *, amount / sum(amount) OVER (PARTITION BY comp_id) * 100 AS w FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY comp_id ORDER BY w - floor(w) DESC, kind) AS k, 100 - sum(floor(w)) OVER (PARTITION BY comp_id) AS rest FROM f)
SELECT comp_id, kind, CAST(floor(w) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS units FROM r"""

QUERIES = {
    "formula_parse": formula_parse, "formula_mass": formula_mass, "composition_check": check, "weight_to_mol": weight_to_mol, "element_fractions": elements,
    "elemental_vector": vector, "composition_distance": distances, "density_model": density, "canonical_composition": canonical, "fu_search": fu_search,
    "molecule_counts": from_molecules, "box_length": box, "compatible_potentials": potentials, "potential_configs": configs, "potential_config_lines": config_lines, "oxygen_charge": charge,
    "pair_energies": pair_energies, "melt_quench_schedule": protocols, "temperature_program": temperatures, "choose_potential": choices, "actual_composition": actual, "composition_share": shares, "largest_remainder": remainders, "job_submission": submission,
}
ORACLES = {
    "formula_parse": f"WITH {G}, {PARSE} SELECT oxide AS formula, element, cnt FROM el",
    "formula_mass": f"WITH {G}, {PARSE}, {M}, t AS (SELECT oxide, sum(cnt * mass) AS s, count(mass) = count(*) AS whole FROM el LEFT JOIN m USING (element) GROUP BY ALL) SELECT oxide AS formula, round(CASE WHEN whole THEN s END, 6) AS mass FROM t",
    "composition_check": CHECK, "weight_to_mol": WEIGHT, "element_fractions": ELEMENTS, "elemental_vector": VECTOR, "composition_distance": DISTANCES,
    "density_model": _density_sql(), "canonical_composition": CANONICAL, "fu_search": FU_SEARCH, "molecule_counts": MOLECULES, "box_length": BOX,
    "compatible_potentials": POTENTIALS, "potential_config_lines": CONFIG_LINES, "oxygen_charge": CHARGE, "pair_energies": _energies_sql(), "melt_quench_schedule": _protocol_sql(), "choose_potential": CHOICES, "actual_composition": ACTUAL,
    "temperature_program": f"WITH p AS ({_protocol_sql()}) SELECT id, first_step AS step, t_from AS temperature FROM p UNION SELECT id, first_step + steps, t_to FROM p",
    "composition_share": SHARES, "largest_remainder": REMAINDERS, "job_submission": _submission_sql(),
}
