"""Dense vectors as array columns, computed in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def mix(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * wa + y * wb)


def finite(a: Column) -> Column:
    """The vector with 0 for nulls, NaN and infinities."""
    return F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))


def robust_cosine(a: Column, b: Column) -> Column:
    """The cosine of the finite parts, within -1 and 1; 0 where either has no length."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(finite(doubles(a)), finite(doubles(b)))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; within a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(a: Column) -> Column:
    """The vector at length 1; one without length stays as it is."""
    return _let(a, lambda v: _let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))))
