"""High-water marks: reading MAX, carrying it as text, filtering above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from haulframe.functions.names import col
from haulframe.functions.types import is_orderable

# Mark text of an instant: the offset keeps it exact in any session time zone.
_INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def mark_type(df: DataFrame, column: str) -> T.DataType:
    """Type of the mark column, checked to have an order."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r} to read a high-water mark from: {df.columns}")
    data_type = df.schema[column].dataType
    if not is_orderable(data_type):
        raise ValueError(f"column {column!r} of type {data_type.simpleString()} has no order")
    return data_type


def max_text(column: str, data_type: T.DataType) -> Column:
    """MAX as text. Python dates would pass through the process time zone; text does not."""
    top = F.max(col(column))
    if isinstance(data_type, T.TimestampType):
        return F.date_format(top, _INSTANT)
    return top.cast("string")


def mark_literal(text: str, data_type: T.DataType) -> Column:
    """The mark as a typed constant, which Spark pushes into the scan."""
    return F.lit(text).cast(data_type)


def high_water_mark(df: DataFrame, column: str) -> str | None:
    """MAX of a column, NULLs ignored; None for an empty frame."""
    return df.agg(max_text(column, mark_type(df, column)).alias("mark")).first()["mark"]


def above(df: DataFrame, column: str, mark: str) -> DataFrame:
    """Rows strictly above a mark. Ties at the mark and NULLs stay out."""
    return df.where(col(column) > mark_literal(mark, mark_type(df, column)))


def from_mark(df: DataFrame, column: str, mark: str) -> DataFrame:
    """Rows at or above a mark."""
    return df.where(col(column) >= mark_literal(mark, mark_type(df, column)))
