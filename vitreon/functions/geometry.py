"""Column expressions over cells (rows c0, c1, c2 are lattice vectors) and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(i: int, j: int) -> Column:
    return F.col(f"c{i}{j}")


def _cross(a: int, b: int) -> list[Column]:
    return [c(a, 1) * c(b, 2) - c(a, 2) * c(b, 1), c(a, 2) * c(b, 0) - c(a, 0) * c(b, 2), c(a, 0) * c(b, 1) - c(a, 1) * c(b, 0)]


def volume() -> Column:
    k = _cross(1, 2)
    return F.abs(c(0, 0) * k[0] + c(0, 1) * k[1] + c(0, 2) * k[2])


def heights() -> list[Column]:
    """Distances between opposite faces: V / |b x c| and so on."""
    return [volume() / F.sqrt(sum((x * x for x in _cross(a, b)), F.lit(0.0))) for a, b in ((1, 2), (2, 0), (0, 1))]


def inverse() -> dict[str, Column]:
    """Elements i00..i22 of the inverse cell: fractional = position * inverse, for row vectors."""
    k = [_cross(1, 2), _cross(2, 0), _cross(0, 1)]
    det = c(0, 0) * k[0][0] + c(0, 1) * k[0][1] + c(0, 2) * k[0][2]
    return {f"i{r}{s}": k[s][r] / det for r in range(3) for s in range(3)}


def fractional(x: Column, y: Column, z: Column) -> list[Column]:
    return [x * F.col(f"i0{s}") + y * F.col(f"i1{s}") + z * F.col(f"i2{s}") for s in range(3)]


def cartesian(f: list[Column]) -> list[Column]:
    return [f[0] * c(0, s) + f[1] * c(1, s) + f[2] * c(2, s) for s in range(3)]


def nearest(df: Column) -> Column:
    """Minimum image of a fractional difference; halves round to even."""
    return df - F.rint(df)


def wrapped(f: Column) -> Column:
    return f - F.floor(f)


def cubic_distance(dx: Column, dy: Column, dz: Column, box: Column) -> Column:
    """Minimum-image distance in a cubic box from absolute differences."""
    total = F.lit(0.0)
    for d in (dx, dy, dz):
        a = F.abs(d)
        a = F.when(a > box * 0.5, box - a).otherwise(a)
        total = total + a * a
    return F.sqrt(total)
