"""Column functions on numbers and vectors. Bad numbers become a default, divisions by nothing null or 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce(c: Column | str, default: float | None = 0.0) -> Column:
    """The number in a text or column; null, NaN and what is no number as ``default``."""
    c = F.col(c) if isinstance(c, str) else c
    x = c.try_cast("double")
    return F.coalesce(F.when(F.isnan(x), F.lit(None)).otherwise(x), F.lit(default))


def whole(c: Column | str, default: int = 0) -> Column:
    """Nearest whole number, halves to the even one; bad numbers as ``default``."""
    return F.coalesce(F.bround(coerce(c, None)).cast("int"), F.lit(default))


def share(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def unit_interval(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def peak(sim: Column, at: float = 0.45) -> Column:
    """Triangle over (0, 1) with its top, 1, ``at`` the given place; 0 outside."""
    return F.when((sim <= 0) | (sim >= 1), F.lit(0.0)).when(sim <= at, sim / at).otherwise((1 - sim) / (1 - at))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector has no length."""
    return share(dot(a, b), norm(a) * norm(b))


def unit(a: Column | str) -> Column:
    """At length one; lengths below 1e-9 count as that. The length is worked out once per vector."""
    v = F.col(a) if isinstance(a, str) else a
    n = F.greatest(F.lit(1e-9), norm(v))
    return F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, y: x.cast("double") / y)


def usable(a: Column | str) -> Column:
    """Neither null nor all zero."""
    a = F.col(a) if isinstance(a, str) else a
    return a.isNotNull() & F.exists(a, lambda x: x != 0)
