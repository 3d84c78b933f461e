"""Bucket paths: the class numbers from the root of the index down to a bucket.

A path is an ``ARRAY<INT>`` as long as its depth. Two text forms exist: the
dotted one for people, and the key ``b4_10`` for joins and columns
(a dotted name such as ``4.10`` could be read back as the number 4.1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearpath.functions.vectors import ColumnLike, _column

EMPTY = -1
ROOT_KEY = "b"


def unpad(path: ColumnLike) -> Column:
    """The part of a padded path before its first empty level."""
    path = _column(path)
    first_empty = F.array_position(path, F.lit(EMPTY)).cast("int")
    return F.when(first_empty > 0, F.slice(path, F.lit(1), first_empty - 1)).otherwise(path)


def pad(path: ColumnLike, n_levels: int) -> Column:
    path = _column(path)
    return F.concat(path, F.array_repeat(F.lit(EMPTY), F.lit(n_levels) - F.size(path)))


def serialize_path(path: ColumnLike) -> Column:
    """``[1, 2, -1, -1]`` to ``1.2``."""
    return F.concat_ws(".", unpad(path).cast("array<string>"))


def deserialize_path(text: ColumnLike, n_levels: int) -> Column:
    """``1.2`` to ``[1, 2, -1, -1]`` for four levels."""
    return pad(F.split(_column(text), r"\.").cast("array<int>"), n_levels)


def path_key(path: ColumnLike) -> Column:
    return F.concat(F.lit(ROOT_KEY), F.concat_ws("_", _column(path).cast("array<string>")))


def key_of(path: Sequence[int]) -> str:
    """:func:`path_key` for a path known on the driver."""
    return ROOT_KEY + "_".join(str(step) for step in path)


def path_of(key: str) -> list[int]:
    """The path of a key."""
    return [int(step) for step in key.removeprefix(ROOT_KEY).split("_") if step]


def path_literal(path: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(step)) for step in path]).cast("array<int>")


def path_equals(path: ColumnLike, wanted: Sequence[int]) -> Column:
    return _column(path) == path_literal(wanted)


def path_starts_with(path: ColumnLike, prefix: Sequence[int]) -> Column:
    if not prefix:
        return F.lit(True)
    return F.slice(_column(path), 1, len(prefix)) == path_literal(prefix)
