"""Rows along a space-filling curve, so that files have narrow ranges of several columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from haulframe.functions.names import col

# Bits of a column's rank: 64 ranges of about equal depth.
BITS = 6
# Ranks are right to within one in so many rows.
ACCURACY = 10_000
# Bytes of a text that decide its rank (a signed long holds seven).
PREFIX = 7


def along_curve(df: DataFrame, columns: Sequence[str], files: int | None = None,
                first: Sequence[str] = ()) -> DataFrame:
    """Rows in ranges of the columns' interleaved ranks, sorted by them within each.

    A column's rank is the number of its quantile that a value reaches, found in one pass over all
    columns by sketches of bounded size. Interleaving the ranks' bits puts rows that are near in
    every column into the same file, whose statistics then prune by any of them. Rows of equal
    ranks are spread by a hash of the row, so a value that a third of the rows share is no single
    task, and a repeated task sends its rows to the same places. NULL has rank 0. ``files`` sets
    the number of ranges; ``first`` names columns that come before the curve.
    """
    if not columns:
        raise ValueError("no columns to lay rows out by")
    ranks = _ranks(df, columns)
    curve = interleaved(ranks)
    tie = F.xxhash64(*[_hashable(df, c) for c in df.columns])
    names = [_free(df, "_curve"), _free(df, "_tie")]
    keyed = df.withColumns({names[0]: curve, names[1]: tie})
    order = [*[col(c) for c in first], *[F.col(n) for n in names]]
    ranged = (keyed.repartitionByRange(files, *order) if files
              else keyed.repartitionByRange(*order))
    by_value = [col(c) for c in columns if df.schema[c].dataType.typeName() != "map"]
    return ranged.sortWithinPartitions(*order[:-1], *by_value).drop(*names)


def interleaved(ranks: Sequence[Column]) -> Column:
    """The bits of the ranks in turn, the highest of each first."""
    curve = F.lit(0).cast("long")
    for bit in range(BITS):
        for i, rank in enumerate(ranks):
            one = F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long")
            curve = curve.bitwiseOR(F.shiftleft(one, bit * len(ranks) + i))
    return curve


def _ranks(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    if len(columns) * BITS > 63:
        raise ValueError(f"at most {63 // BITS} columns fit the curve")
    shares = F.array(*[F.lit(i / 2**BITS) for i in range(1, 2**BITS)])
    values = [ordinal(col(c), df.schema[c].dataType, c) for c in columns]
    found = df.agg(*[F.percentile_approx(v, shares, F.lit(ACCURACY)) for v in values]).first()
    return [_rank(v, sorted(set(points or []))) for v, points in zip(values, found)]


def _rank(value: Column, points: list) -> Column:
    """How many points a value reaches, by a tree of comparisons."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(points[middle]), tree(middle + 1, high)).otherwise(
            tree(low, middle))

    return F.when(value.isNull(), F.lit(0)).otherwise(tree(0, len(points)))


def ordinal(value: Column, kind: T.DataType, name: str) -> Column:
    """A number in the order of the column's values."""
    if isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType)):
        return value
    if isinstance(kind, T.DecimalType):
        return value.cast("double")
    if isinstance(kind, T.BooleanType):
        return value.cast("int")
    if isinstance(kind, T.DateType):
        return F.unix_date(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        # Within the session's zone, which keeps the order but for an hour a year.
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.rpad(F.substring(F.hex(value), 1, 2 * PREFIX), 2 * PREFIX, "0")
        return F.conv(head, 16, 10).cast("long")
    raise ValueError(f"{name} is {kind.simpleString()}, which has no order")


def _hashable(df: DataFrame, name: str) -> Column:
    """Nested values as text: a hash takes no maps and no variants."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(F.struct(col(name)))
    return col(name)


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
