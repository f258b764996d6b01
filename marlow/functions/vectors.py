"""Vector arithmetic as column expressions; all sums are in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Rows of unit length; norms are floored at 1e-8."""
    return F.element_at(F.transform(F.array(F.greatest(norm(v), F.lit(1e-8))), lambda n: F.transform(doubles(v), lambda x: x / n)), 1)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))


def repaired(v: Column) -> Column:
    """NaN to 0 and infinities to the largest float."""
    top = F.lit(3.4028234663852886e38)
    return F.transform(doubles(v), lambda x: F.when(F.isnan(x), 0.0).when(x > top, top).when(x < -top, -top).otherwise(x))


def width(*tables: DataFrame) -> int:
    """The width of the first vector found in ``tables``; 0 without any."""
    for t in tables:
        if r := t.where("vector IS NOT NULL").select(F.size("vector")).first():
            return r[0]
    return 0


def padded(bag: Column, length: int, dim: int) -> Column:
    """An array of vectors cut or filled up with zero vectors to ``length``."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.slice(F.concat(bag, F.array_repeat(zero, length)), 1, length)
