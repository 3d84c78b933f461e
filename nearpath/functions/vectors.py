"""Column expressions over dense vectors held in array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; inside a lambda it would run per element."""
    return F.transform(F.array(value), body)[0]


def as_doubles(vector: ColumnLike) -> Column:
    return _column(vector).cast("array<double>")


def as_floats(vector: ColumnLike) -> Column:
    return _column(vector).cast("array<float>")


def dot(left: ColumnLike, right: ColumnLike) -> Column:
    """Inner product; null when the lengths differ."""
    products = F.zip_with(as_doubles(left), as_doubles(right), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(vector: ColumnLike) -> Column:
    squares = F.aggregate(as_doubles(vector), F.lit(0.0), lambda total, x: total + x * x)
    return F.sqrt(squares)


def l2_normalize(vector: ColumnLike) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    values = as_doubles(vector)
    return _let(
        norm(vector),
        lambda length: F.when(length == 0, values).otherwise(
            F.transform(values, lambda x: x / length)
        ),
    )


def inner_product_distance(left: ColumnLike, right: ColumnLike) -> Column:
    return 1 - dot(left, right)


def cosine_distance(left: ColumnLike, right: ColumnLike) -> Column:
    """One minus the cosine; a zero vector has distance 1 to everything."""
    return _let(
        norm(left) * norm(right),
        lambda lengths: F.when(lengths == 0, F.lit(1.0)).otherwise(
            1 - dot(left, right) / lengths
        ),
    )
