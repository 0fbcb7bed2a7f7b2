"""Compositions: formulas, masses, validation, shares, canonical strings, density, apportionment, planning.

Tables are long: comp_id, pos, oxide, amount. Everything is an aggregation or window by comp_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import constants as C
from ..functions import lookup as L

FORMULA = r"([A-Z][a-z]*)(\d*)"


def parse(formulas: DataFrame, col: str = "formula") -> DataFrame:
    """formula, element, cnt: repeated elements add up; a missing number is 1. No parentheses, no decimals."""
    pairs = F.arrays_zip(F.regexp_extract_all(col, F.lit(FORMULA), 1).alias("e"), F.regexp_extract_all(col, F.lit(FORMULA), 2).alias("n"))
    one = formulas.select(col).distinct().select(col, F.explode(pairs).alias("p"))
    n = F.coalesce(F.nullif(F.col("p.n"), F.lit("")).cast("bigint"), F.lit(1).cast("bigint"))
    return one.groupBy(col, F.col("p.e").alias("element")).agg(F.sum(n).alias("cnt"))


def formula_mass(formulas: DataFrame, col: str = "formula") -> DataFrame:
    """formula, mass in g/mol; null if an element has no known mass."""
    got = parse(formulas, col).join(F.broadcast(L.masses(formulas.sparkSession)), "element", "left")
    whole = F.count("mass") == F.count("*")
    return got.groupBy(col).agg(F.when(whole, F.sum(F.col("cnt") * F.col("mass"))).alias("mass"))


def share(value: Column, by: str | list[str]) -> Column:
    """value over its sum in the group; null where the sum isn't positive."""
    total = F.sum(value).over(W.partitionBy(by))
    return F.when(total > 0, value / total)


def weight_to_mol(comp: DataFrame) -> DataFrame:
    """comp_id, oxide, fraction: mol fractions of weights in amount."""
    mass = formula_mass(comp.select(F.col("oxide").alias("formula"))).withColumnRenamed("formula", "oxide")
    return comp.join(mass, "oxide").withColumn("fraction", share(F.col("amount") / F.col("mass"), "comp_id"))


def mol_fractions(comp: DataFrame, mode: str = "molar") -> DataFrame:
    if mode.lower() == "molar":
        return comp.withColumn("fraction", share(F.col("amount"), "comp_id"))
    if mode.lower() == "weight":
        return weight_to_mol(comp)
    raise ValueError(f"unknown mode: {mode}")


def neutral(formulas: DataFrame, col: str = "formula") -> DataFrame:
    """formula, neutral: whether some combination of common oxidation states sums to zero; a lone element isn't.

    Formulas of the density model whose numbers are the letters x and y pass.
    """
    got = parse(formulas, col).join(F.broadcast(L.oxidation_states(formulas.sparkSession)), "element", "left")
    part = F.struct("cnt", "states")
    one = got.groupBy(col).agg(F.collect_list(part).alias("p"), F.count("*").alias("k"), F.count("states").alias("known"))
    # all sums that combinations reach, element by element (a formula has a handful)
    sums = F.aggregate("p", F.array(F.lit(0).cast("bigint")), lambda acc, e: F.array_distinct(F.flatten(F.transform(acc, lambda a: F.transform(e["states"], lambda q: a + q * e["cnt"])))))
    ok = (F.col("known") == F.col("k")) & (F.col("k") > 1) & F.array_contains(sums, F.lit(0).cast("bigint"))
    return one.select(col, (F.coalesce(ok, F.lit(False)) | F.col(col).endswith("xOy")).alias("neutral"))


def check(comp: DataFrame, tolerance: float = C.COMPOSITION_TOLERANCE) -> DataFrame:
    """comp_id, status, total: 'ok' or the first fault of negative, element, neutral, sum. Sums near 1 or 100 are ok."""
    spark = comp.sparkSession
    known = parse(comp.select("oxide"), "oxide").join(F.broadcast(L.elements(spark).select(F.col("symbol").alias("element"), "atomic_number")), "element", "left")
    known = known.groupBy("oxide").agg(F.bool_and(F.col("atomic_number").isNotNull() | F.col("oxide").endswith("xOy")).alias("known"))
    df = comp.join(known, "oxide", "left").join(neutral(comp.select("oxide"), "oxide"), "oxide", "left")
    got = df.groupBy("comp_id").agg(
        F.min("amount").alias("least"), F.sum("amount").alias("total"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"), F.bool_and(F.coalesce("neutral", F.lit(False))).alias("neutral")
    )
    near = (F.abs(F.col("total") - 1.0) <= tolerance) | (F.abs(F.col("total") - 100.0) <= 100.0 * tolerance)
    status = F.when(F.col("least") < 0, "negative").when(~F.col("known"), "element").when(~F.col("neutral"), "neutral").when(~near, "sum").otherwise("ok")
    return got.select("comp_id", status.alias("status"), "total")


def extract(comp: DataFrame, tolerance: float = C.COMPOSITION_TOLERANCE) -> DataFrame:
    """Fractions of the compositions that check() finds ok."""
    ok = check(comp, tolerance).where("status = 'ok'").select("comp_id")
    return comp.join(ok, "comp_id", "left_semi").withColumn("fraction", share(F.col("amount"), "comp_id"))


def stoichiometry(comp: DataFrame) -> DataFrame:
    return parse(comp.select("oxide"), "oxide").withColumnRenamed("cnt", "per_unit")


def element_fractions(comp: DataFrame) -> DataFrame:
    """comp_id, element, fraction: atoms of each element over all atoms."""
    got = comp.join(parse(comp.select("oxide"), "oxide"), "oxide").groupBy("comp_id", "element").agg(F.sum(F.col("amount") * F.col("cnt")).alias("atoms"))
    return got.select("comp_id", "element", share(F.col("atoms"), "comp_id").alias("fraction"))


def vectors(fractions: DataFrame, size: int = 119) -> DataFrame:
    """comp_id, vector: dense fractions indexed by atomic number (0 unused)."""
    z = L.elements(fractions.sparkSession).select(F.col("symbol").alias("element"), "atomic_number")
    m = fractions.join(F.broadcast(z), "element").groupBy("comp_id").agg(F.map_from_entries(F.collect_list(F.struct("atomic_number", "fraction"))).alias("m"))
    return m.select("comp_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def devector(rows: DataFrame) -> DataFrame:
    """comp_id, element, fraction of the positive entries of vector."""
    z = L.elements(rows.sparkSession).select(F.col("symbol").alias("element"), "atomic_number")
    one = rows.select("comp_id", F.posexplode("vector").alias("atomic_number", "fraction")).where("fraction > 0")
    return one.join(F.broadcast(z), "atomic_number").select("comp_id", "element", "fraction")


def canonical(comp: DataFrame) -> DataFrame:
    """comp_id, canonical: 'CaO 15 - Na2O 15 - SiO2 70', oxides in order, amounts of 2 decimals without zeros."""
    item = F.struct("oxide", L.fmt_amount(F.col("amount")).alias("a"))
    rows = comp.groupBy("comp_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return rows.select("comp_id", F.array_join(F.transform("l", lambda e: F.concat_ws(" ", e["oxide"], e["a"])), " - ").alias("canonical"))


def from_canonical(rows: DataFrame) -> DataFrame:
    """comp_id, pos, oxide, amount of canonical strings."""
    one = rows.select("comp_id", F.posexplode(F.split("canonical", " - ")).alias("pos", "t"))
    return one.select("comp_id", "pos", F.regexp_extract("t", r"^(\S+)", 1).alias("oxide"), F.regexp_extract("t", r"(\S+)$", 1).cast("double").alias("amount"))


def distance(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (id_a, id_b) with the distance of their element fractions (comp_id, element, fraction) in a and b.

    A missing element is 0, so every pair has a row; an unknown id is a composition without elements. Each side becomes one
    map a composition, and meets the pairs by id: nothing is joined by element.
    """
    whole = lambda df, i, m: df.groupBy(F.col("comp_id").alias(i)).agg(F.map_from_entries(F.collect_list(F.struct("element", "fraction"))).alias(m))
    none = F.create_map().cast("map<string,double>")
    df = pairs.join(whole(a, "id_a", "_a"), "id_a", "left").join(whole(b, "id_b", "_b"), "id_b", "left")
    df = df.withColumns({"_a": F.coalesce("_a", none), "_b": F.coalesce("_b", none)})
    keys = F.array_sort(F.array_union(F.map_keys("_a"), F.map_keys("_b")))
    gap = lambda e: F.coalesce(F.element_at("_a", e), F.lit(0.0)) - F.coalesce(F.element_at("_b", e), F.lit(0.0))
    d2 = F.aggregate(F.transform(keys, lambda e: gap(e) * gap(e)), F.lit(0.0), lambda x, y: x + y)
    return df.select("id_a", "id_b", F.sqrt(d2).alias("distance"))


# Oxides that the density model lumps together.
TRACE = "Ag2O Bi2O3 Br CoxOy Cr2O3 Cs2O CuO Ga2O3 Gd2O3 I MoO3 Nb2O5 PdO PrxOy Rb2O RexOy RhxOy RuO2 SeO2 Sm2O3 SnO2 TeO2 Tl2O3 WO3 Y2O3".split()


def density(fractions: DataFrame) -> DataFrame:
    """comp_id, density in g/cm3 of the polynomial in mol%; null if a component is unknown to the model."""
    spark = fractions.sparkSession
    known = {p for k in C.DENSITY_TERMS for p in k.split("_") if not p.isdigit()}
    pct = fractions.groupBy("comp_id").agg(
        F.map_from_entries(F.collect_list(F.struct("oxide", (F.col("fraction") * 100).alias("c")))).alias("m"),
        F.sum(F.when(F.col("oxide").isin(TRACE), F.col("fraction") * 100).otherwise(0.0)).alias("trace"),
        F.bool_and(F.col("oxide").isin(*known, *TRACE, "SiO2")).alias("known"),
    )
    terms = pct.select("comp_id", "m", "trace", "known", F.explode(F.map_keys("m")).alias("oxide")).join(F.broadcast(L.density_terms(spark)), F.array_contains("parts", F.col("oxide")) & (F.col("parts")[0] == F.col("oxide")), "left")
    value = F.when(F.size(F.array_except("parts", F.map_keys("m"))) == 0, F.aggregate("parts", F.col("coef"), lambda acc, p: acc * F.try_element_at("m", p)))
    total = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("place", value.alias("v")))), lambda t: t["v"]), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    out = terms.groupBy("comp_id", "trace", "known").agg(total.alias("t"))
    return out.select("comp_id", F.when(F.col("known"), F.lit(C.DENSITY_B0) + F.lit(C.DENSITY_REMAINDER) * F.col("trace") + F.col("t")).alias("density"))


def largest_remainder(df: DataFrame, by: str | list[str], fraction: str, total: Column, order: str) -> DataFrame:
    """df with units: floor(fraction * total), and one more in the order of the remainders until the total is met."""
    w = F.col(fraction) * total
    win = W.partitionBy(by)
    rest = total - F.sum(F.floor(w)).over(win)
    rank = F.row_number().over(win.orderBy((w - F.floor(w)).desc(), F.col(order)))
    return df.withColumn("units", (F.floor(w) + (rank <= rest).cast("int")).cast("bigint"))


def from_molecules(df: DataFrame, n_molecules: int) -> DataFrame:
    """df (comp_id, pos, oxide, fraction) with units: half-even rounding, the gap goes to the largest fraction."""
    win = W.partitionBy("comp_id")
    u = F.rint(F.col("fraction") * n_molecules).cast("bigint")
    gap = F.lit(n_molecules) - F.sum(u).over(win)
    first = F.row_number().over(win.orderBy(F.col("fraction").desc(), "pos")) == 1
    return df.withColumn("units", (u + F.when(first, gap).otherwise(0)).cast("bigint"))


def _nearest_total(f: np.ndarray, apu: np.ndarray, guess: int, target: int, half_width: int) -> tuple[int, int | None]:
    """Of all totals of units around the guess the best, and its atoms: largest_remainder of each, as one table of totals by oxides."""
    n = np.arange(max(1, guess - half_width), guess + half_width + 1)
    if np.isnan(f).any():
        return int(n[0]), None
    w = f * n[:, None]
    whole = np.floor(w)
    order = np.argsort(whole - w, axis=1, kind="stable")
    more = np.zeros(w.shape, np.int64)
    np.put_along_axis(more, order, (np.arange(1, len(f) + 1) <= (n - whole.sum(axis=1))[:, None]).astype(np.int64), axis=1)
    atoms = ((whole.astype(np.int64) + more) * apu).sum(axis=1)
    k = np.lexsort((n, atoms, np.abs(atoms - target)))[0]
    return int(n[k]), int(atoms[k])


def to_atoms(df: DataFrame, target: int, half_width: int = 1000) -> DataFrame:
    """df (comp_id, pos, oxide, fraction) with units, n_units, n_atoms closest to the target number of atoms.

    All unit totals within half_width of the estimate compete: least distance, then fewer atoms, then fewer units.
    """
    per = parse(df.select("oxide"), "oxide").groupBy("oxide").agg(F.sum("cnt").alias("apu"))
    df = df.join(per, "oxide")
    part = F.array_sort(F.collect_list(F.struct("pos", "fraction", "apu")))
    guess = F.greatest(F.lit(1), F.rint(F.lit(float(target)) / F.sum(F.col("fraction") * F.col("apu")))).cast("bigint")

    @F.pandas_udf("struct<n_units:bigint,n_atoms:bigint>")
    def nearest(fractions: pd.Series, apu: pd.Series, guesses: pd.Series) -> pd.DataFrame:
        got = [_nearest_total(np.array(f, float), np.array(a, np.int64), int(g), target, half_width) for f, a, g in zip(fractions, apu, guesses, strict=True)]
        return pd.DataFrame({"n_units": pd.array([g[0] for g in got], "Int64"), "n_atoms": pd.array([g[1] for g in got], "Int64")})

    one = df.groupBy("comp_id").agg(part.alias("p"), guess.alias("guess"))
    best = one.select("comp_id", nearest(F.col("p.fraction"), F.col("p.apu"), "guess").alias("b")).select("comp_id", "b.n_units", "b.n_atoms")
    return largest_remainder(df.join(best, "comp_id"), "comp_id", "fraction", F.col("n_units"), "pos").drop("apu")


def plan(comp: DataFrame, target: int, target_type: str = "atoms", mode: str = "molar") -> DataFrame:
    """Formula units and atoms of each composition for a number of atoms or of molecules."""
    if target_type not in ("atoms", "molecules"):
        raise ValueError(f"unknown target type: {target_type}")
    df = mol_fractions(comp, mode)
    return to_atoms(df, target) if target_type == "atoms" else from_molecules(df, target)


def element_counts(units: DataFrame) -> DataFrame:
    got = units.join(parse(units.select("oxide"), "oxide"), "oxide")
    return got.groupBy("comp_id", "element").agg(F.sum(F.col("units") * F.col("cnt")).alias("atoms"))


def box_length(units: DataFrame, densities: DataFrame) -> DataFrame:
    """comp_id, box: edge in angstrom of the cube that holds the units at the density (comp_id, density)."""
    mass = formula_mass(units.select(F.col("oxide").alias("formula"))).withColumnRenamed("formula", "oxide")
    m = units.join(mass, "oxide").groupBy("comp_id").agg(F.sum(F.col("units") * F.col("mass")).alias("m"))
    return m.join(densities, "comp_id").select("comp_id", F.cbrt(F.col("m") / F.lit(C.AVOGADRO) / F.col("density") * 1e24).alias("box"))


# --- potentials -------------------------------------------------------------------------------------


def compatible(elements: DataFrame) -> DataFrame:
    """comp_id, potentials: those whose elements hold all of the composition's (comp_id, element), by preference."""
    spark = elements.sparkSession
    table = L.potential_elements(spark)
    want = elements.select("comp_id", "element").distinct()
    n = want.groupBy("comp_id").agg(F.count("*").alias("need"))
    have = want.join(F.broadcast(table), "element").groupBy("comp_id", "potential", "preference").agg(F.count("*").alias("have"))
    ok = have.join(n, "comp_id").where("have = need").groupBy("comp_id").agg(F.array_sort(F.collect_list(F.struct("preference", "potential"))).alias("l"))
    return n.select("comp_id").join(ok, "comp_id", "left").select("comp_id", F.coalesce(F.transform("l", lambda e: e["potential"]), F.array().cast("array<string>")).alias("potentials"))


def select_potential(elements: DataFrame) -> DataFrame:
    return compatible(elements).select("comp_id", F.try_element_at("potentials", F.lit(1)).alias("potential"))


def oxygen_charge(counts: DataFrame) -> DataFrame:
    """comp_id, charge: that of oxygen which makes the SHIK charges neutral; null without oxygen."""
    rows = [f"('{e}', {q!r}D)" for e, q in C.SHIK_CHARGES.items()]
    q = L.values(counts.sparkSession, rows, "element, q")
    got = counts.join(F.broadcast(q), "element", "left").groupBy("comp_id").agg(
        F.sum(F.when(F.col("element") != "O", F.col("q") * F.col("atoms")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("element") == "O", F.col("atoms")).otherwise(0)).alias("n")
    )
    return got.select("comp_id", (-F.col("plus") / F.nullif(F.col("n"), F.lit(0))).alias("charge"))


def choose_potential(requests: DataFrame, elements: DataFrame, default: str = "pmmcs") -> DataFrame:
    """requests (comp_id, potential or null) with chosen and status: a named potential must cover the elements ('unsupported'
    if not); the default gives way to the best that does ('none' if there is none)."""
    df = requests.join(compatible(elements), "comp_id", "left")
    asked = F.coalesce("potential", F.lit(default))
    covers = F.coalesce(F.array_contains("potentials", asked), F.lit(False))
    best = F.try_element_at("potentials", F.lit(1))
    chosen = F.when(covers, asked).when(asked == default, best)
    status = F.when(chosen.isNotNull(), "ok").when(asked == default, "none").otherwise("unsupported")
    return df.select("comp_id", chosen.alias("chosen"), status.alias("status"))


def actual_composition(counts: DataFrame) -> DataFrame:
    """comp_id, atoms, text: 'Na 40, O 180, Si 80' of element counts, elements in order."""
    item = F.struct("element", "atoms")
    rows = counts.groupBy("comp_id").agg(F.sum("atoms").alias("atoms"), F.array_sort(F.collect_list(item)).alias("l"))
    return rows.select("comp_id", "atoms", F.array_join(F.transform("l", lambda e: F.concat_ws(" ", e["element"], e["atoms"].cast("string"))), ", ").alias("text"))
