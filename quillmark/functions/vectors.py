"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

SMALL = 1e-8


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """0 if either norm is below 1e-8; different lengths give null, or an error if ``strict``."""
    score = F.when((l2_norm(a) < SMALL) | (l2_norm(b) < SMALL), F.lit(0.0)).otherwise(dot(a, b) / (l2_norm(a) * l2_norm(b)))
    other = F.raise_error(F.lit("vectors of different lengths")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(F.size(a) == F.size(b), score).otherwise(other)


def l2_normalize(v: Column) -> Column:
    norm = l2_norm(v)
    return F.when(norm < SMALL, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: F.round(x.cast("double") / norm, 8)))


def dims_ok(v: Column, expected: Column) -> Column:
    return (F.coalesce(expected, F.lit(0)) <= 0) | (F.size(v) == expected)
