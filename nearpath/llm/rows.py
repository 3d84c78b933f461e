"""Documents as Arrow rows: what the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def id_and_text(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """Only ``doc_id`` and ``text``: other columns, whatever their names, stay out.
    A null text is an empty one. ``carry`` holds the whole row but its text in the
    struct ``rest``, for an operator that gives all columns back."""
    columns = [
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ]
    if carry:
        others = [F.col(f"`{name}`") for name in docs.columns if name != text_col]
        columns.append(F.struct(*others).alias("rest"))
    return docs.select(*columns)


def unpack_rest(rows: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` of ``text`` and ``rest`` with the columns of ``docs`` again."""
    return rows.select(*(
        F.col("text").alias(name) if name == text_col else F.col(f"rest.`{name}`").alias(name)
        for name in docs.columns
    ))


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere: what rows that went through Arrow have."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def unused_name(frame: DataFrame, name: str) -> str:
    """The name, or one like it that no column has."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def input_tasks(frame: DataFrame, least: int = 8) -> int:
    """How many tasks scan the frame: follows its bytes, costs no job."""
    return max(least, frame.rdd.getNumPartitions())


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes in a string column, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def table(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )


def spark_schema(schema: pa.Schema) -> str:
    names = {
        pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean",
        pa.string(): "string", pa.binary(): "binary",
    }
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)
