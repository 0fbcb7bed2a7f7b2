"""Constant tables as small DataFrames: their size is fixed, so joins with them may broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C


def values(spark: SparkSession, rows: list[str], names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")


def elements(spark: SparkSession) -> DataFrame:
    """atomic_number, symbol, mass (null if unknown), role."""
    role = {s: "former" for s in C.FORMERS + C.INTERMEDIATES} | {s: "modifier" for s in C.MODIFIERS} | {"O": "oxygen"}
    rows = [f"({z}, '{s}', CAST({C.MASSES.get(s, 'NULL')} AS DOUBLE), '{role.get(s, 'modifier')}', {str(s in role).lower()})" for s, z in C.Z.items()]
    return values(spark, rows, "atomic_number, symbol, mass, role, known")


def masses(spark: SparkSession) -> DataFrame:
    return values(spark, [f"('{s}', {m!r}D)" for s, m in C.MASSES.items()], "element, mass")


def oxidation_states(spark: SparkSession) -> DataFrame:
    return values(spark, [f"('{s}', array({', '.join(map(str, q))}))" for s, q in C.OXIDATION_STATES.items()], "element, states")


def potential_elements(spark: SparkSession) -> DataFrame:
    names = {"pmmcs": C.PMMCS, "shik": C.SHIK_CHARGES, "bjp": C.BJP_CHARGES}
    return values(spark, [f"('{p}', {C.POTENTIAL_ORDER.index(p)}, '{e}')" for p in C.POTENTIAL_ORDER for e in names[p]], "potential, preference, element")


def density_terms(spark: SparkSession) -> DataFrame:
    """term, parts (oxides, repeated for powers), coef, place (fixed summation order)."""
    rows = []
    for i, (k, v) in enumerate(C.DENSITY_TERMS.items()):
        names = k.split("_")
        if names[-1].isdigit():
            names = names[:-1] * int(names[-1])
        rows.append(f"('{k}', array({', '.join(repr(n) for n in names)}), {v!r}D, {i})")
    return values(spark, rows, "term, parts, coef, place")


def protocol_stages(spark: SparkSession) -> DataFrame:
    """potential, stage, t_from, t_to ('high' or 'low'), steps (null: of heating or cooling), kind, p_from, p_to, in_fs."""
    rows = []
    for p, stages in C.PROTOCOLS.items():
        for i, (a, b, n, p0, p1) in enumerate(stages):
            steps, kind = (n, "hold") if isinstance(n, int) else ("NULL", n)
            nul = lambda v: "NULL" if v is None else f"{v!r}D"
            rows.append(f"('{p}', {i + 1}, '{a}', '{b}', CAST({steps} AS BIGINT), '{kind}', CAST({nul(p0)} AS DOUBLE), CAST({nul(p1)} AS DOUBLE), {str(p in C.PROTOCOL_FS).lower()})")
    return values(spark, rows, "potential, stage, t_from, t_to, steps, kind, p_from, p_to, in_fs")


def fmt_amount(v: Column) -> Column:
    """Two decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", v), "0+$", ""), r"\.$", "")
