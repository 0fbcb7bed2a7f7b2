"""Force-field inputs as text, one row a structure, and pair tables; parameters are broadcast constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import constants as C
from ..functions import lookup as L
from . import composition as comp


def typed(elements: DataFrame) -> DataFrame:
    """comp_id, element, type: alphabetical numbers from 1."""
    return elements.select("comp_id", "element").distinct().withColumn("type", F.row_number().over(W.partitionBy("comp_id").orderBy("element")))


def _lines(df: DataFrame, section: int, order: list[str], line: Column) -> DataFrame:
    return df.select("comp_id", F.struct(F.lit(section).alias("s"), *(F.col(c).cast("int").alias(f"o{i}") for i, c in enumerate(order)), *(F.lit(0).alias(f"o{i}") for i in range(len(order), 2)), line.alias("t")).alias("l"))


def _assemble(types: DataFrame, name: str, model: str, parts: list[DataFrame], fixed: list[tuple[int, str]]) -> DataFrame:
    ids = types.select("comp_id").distinct()
    for section, text in fixed:
        parts.append(_lines(ids, section, [], F.lit(text)))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    text = all_.groupBy("comp_id").agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]).alias("config"))
    species = types.groupBy("comp_id").agg(F.array_sort(F.collect_list("element")).alias("species"))
    return species.join(text, "comp_id").select("comp_id", F.lit(name).alias("name"), F.lit(model).alias("model"), "species", "config")


def _pairs(types: DataFrame) -> DataFrame:
    a = types.select("comp_id", F.col("element").alias("ea"), F.col("type").alias("ta"))
    b = types.select("comp_id", F.col("element").alias("eb"), F.col("type").alias("tb"))
    return a.join(b, "comp_id").where("ta <= tb")


def _params(spark: SparkSession, table: dict) -> DataFrame:
    rows = [f"('{min(k)}', '{max(k)}', array({', '.join(repr(str(float(x))) for x in v)}))" for k, v in table.items()]
    return L.values(spark, rows, "lo, hi, p")


def _with_params(types: DataFrame, table: dict) -> DataFrame:
    p = F.broadcast(_params(types.sparkSession, table))
    df = _pairs(types)
    return df.join(p, (F.least("ea", "eb") == F.col("lo")) & (F.greatest("ea", "eb") == F.col("hi")), "left")


def _head(types: DataFrame, charges: DataFrame) -> list[DataFrame]:
    df = types.join(charges, ["comp_id", "element"], "left") if "comp_id" in charges.columns else types.join(F.broadcast(charges), "element", "left")
    return [
        _lines(types, 1, ["type"], F.concat(F.lit("group "), "element", F.lit(" type "), "type")),
        _lines(df, 3, ["type"], F.concat(F.lit("set type "), F.col("type"), F.lit(" charge "), F.col("q"))),
    ]


def missing_pairs(elements: DataFrame, potential: str) -> DataFrame:
    """comp_id, a, b: pairs that the potential needs and lacks (pmmcs, shik: with oxygen; bjp: all)."""
    types = typed(elements)
    if potential == "pmmcs":
        return types.where(~F.col("element").isin(*C.PMMCS)).select("comp_id", F.col("element").alias("a"), F.lit("O").alias("b"))
    df = _with_params(types, C.SHIK if potential == "shik" else C.BJP).where("p is null")
    if potential == "shik":
        df = df.where((F.col("ea") == "O") | (F.col("eb") == "O"))
    return df.select("comp_id", F.col("ea").alias("a"), F.col("eb").alias("b"))


def config(elements: DataFrame, potential: str = "pmmcs", counts: DataFrame | None = None, table_dir: str = ".", melt: bool = True) -> DataFrame:
    """comp_id, name, model, species, config (lines of the input) of each composition's elements (comp_id, element).

    Compositions that lack a pair have no row. shik needs counts (comp_id, element, atoms) for oxygen's charge.
    """
    spark = elements.sparkSession
    potential = potential.lower()
    if potential not in C.POTENTIAL_ORDER:
        raise ValueError(f"unknown potential: {potential}")
    bad = missing_pairs(elements, potential).select("comp_id").distinct()
    types = typed(elements).join(bad, "comp_id", "left_anti")
    if potential == "pmmcs":
        q = L.values(spark, [f"('{e}', '{v[0]}')" for e, v in C.PMMCS.items()], "element, q")
        p = L.values(spark, [f"('{e}', '{' '.join(map(str, (*v[1], v[2])))}')" for e, v in C.PMMCS.items()], "element, p")
        o = types.where("element = 'O'").select("comp_id", F.col("type").alias("to"))
        pair = _lines(types.join(F.broadcast(p), "element").join(o, "comp_id"), 5, ["type"], F.concat(F.lit("pair_coeff "), "type", F.lit(" "), "to", F.lit(" pedone "), "p"))
        fixed = [(0, "units metal"), (0, "dimension 3"), (0, "atom_style charge"), (4, "pair_style hybrid/overlay coul/dsf 0.25 8.0 pedone 5.5"), (4, "pair_coeff * * coul/dsf"), (6, "pair_modify shift yes")]
        return _assemble(types, "PMMCS", "PMMCS", [*_head(types, q), pair], fixed)
    if potential == "bjp":
        q = L.values(spark, [f"('{e}', '{v}')" for e, v in C.BJP_CHARGES.items()], "element, q")
        nums = F.array_join(F.transform("p", lambda x: F.format_string("%.6f", x.cast("double"))), " ")
        pair = _lines(_with_params(types, C.BJP), 5, ["ta", "tb"], F.concat(F.lit("pair_coeff "), "ta", F.lit(" "), "tb", F.lit(" "), nums))
        fixed = [(0, "units metal"), (0, "dimension 3"), (0, "atom_style charge"), (4, "pair_style born/coul/dsf 0.25 8.0"), (6, "pair_modify shift yes")]
        return _assemble(types, "BJP", "Born-Mayer-Huggins_coulomb_DSF", [*_head(types, q), pair], fixed)
    if counts is None:
        raise ValueError("the charge of oxygen needs counts")
    rows = [f"('{e}', {v!r}D)" for e, v in C.SHIK_CHARGES.items() if e != "O"]
    q = typed(elements).select("comp_id", "element").join(F.broadcast(L.values(spark, rows, "element, v")), "element", "left").join(comp.oxygen_charge(counts), "comp_id", "left")
    q = q.select("comp_id", "element", F.coalesce("v", "charge").cast("string").alias("q"))
    name = F.concat(F.lit(f'pair_coeff '), "ta", F.lit(" "), "tb", F.lit(f' table "{table_dir}/table_'), "ea", F.lit("-"), "eb", F.lit('.tbl" SHIK_Buck_r24 10.0'))
    pair = _lines(_with_params(types, C.SHIK).where("p is not null"), 5, ["ta", "tb"], name)
    fixed = [(0, "dimension 3"), (0, "atom_style charge"), (4, "pair_style hybrid/overlay coul/dsf 0.2 10.0 table spline 10000"), (4, "pair_coeff * * coul/dsf"), (6, "pair_modify shift yes"), (7, "thermo_style custom step temp pe etotal pxx pxy pxz pyy pyz pzz vol"), (8, "thermo_modify flush yes"), (9, "thermo 100")]
    if melt:
        fixed += [(10, "fix langevinnve all langevin 5000 5000 0.01 48279"), (11, "fix ensemblenve all nve/limit 0.5"), (12, "run 10000"), (13, "unfix langevinnve"), (14, "unfix ensemblenve")]
    return _assemble(types, "SHIK", "SHIK", [*_head(types, q), pair], fixed)


def energy_force(r: Column, a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """A exp(-B r) - C / r^6 + D / r^24, and minus its derivative."""
    v = a * F.exp(-b * r) - c / F.pow(r, F.lit(6.0)) + d / F.pow(r, F.lit(24.0))
    f = a * b * F.exp(-b * r) - 6 * c / F.pow(r, F.lit(7.0)) + 24 * d / F.pow(r, F.lit(25.0))
    return v, f


def pair_table(spark: SparkSession, pair: tuple[str, str], r_min: float = 0.1, r_max: float = 10.5, n: int = 50_000) -> DataFrame:
    """i, r, energy, force of a SHIK pair on a grid even in r squared."""
    p = C.SHIK.get(pair) or C.SHIK[pair[::-1]]
    k = (F.col("id") - 1) / F.lit(float(n - 1))
    r = F.sqrt(F.lit(r_min**2) + k * (r_max**2 - r_min**2))
    df = spark.range(1, n + 1).withColumn("r", r)
    v, f = energy_force(F.col("r"), *(F.lit(float(x)) for x in p))
    return df.select(F.col("id").alias("i"), "r", v.alias("energy"), f.alias("force"))
