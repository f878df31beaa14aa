"""Array and vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.schemas import LEVELS

EPSILON = 1e-12


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(EPSILON))
    return F.transform(v, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPSILON)) * F.greatest(norm(b), F.lit(EPSILON)))


def prefixes(a: Column) -> Column:
    """All prefixes of an array, shortest first."""
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.slice(a, F.lit(1), i)))


def paired(a: Column, b: Column) -> Column:
    """Elements side by side, as many as the shorter array has."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def level_rank(c: Column) -> Column:
    """0 for the least strict level and up; null for other texts."""
    ranks = F.create_map(*[F.lit(x) for i, name in enumerate(LEVELS) for x in (name, i)])
    return F.try_element_at(ranks, c)


def ceil_div(a: Column, b) -> Column:
    return F.ceil(a / b).cast("long")


def percentage(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole * 100
