"""Constraint checks as jobs.

A violation is a row a keyed database would refuse: every NULL in a required column, every text
over its length, every row after the first of a key, every child row without a parent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from haulframe.contract import Contract
from haulframe.functions.names import col
from haulframe.operators.conform import unpivot
from haulframe.operators.references import fk_orphans, key_conflicts

_LABELS = ("table", "constraint", "column")


class ConstraintError(ValueError):
    """Rows break the contract; nothing was written."""

    def __init__(self, violations: list[dict]):
        self.violations = violations
        listed = "; ".join("{table}.{column} {constraint}: {violations}".format(**v)
                           for v in violations)
        super().__init__(f"contract broken, nothing written: {listed}")


def pk_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count. Keys holding a NULL are left to
    the null check."""
    present = reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])
    return (df.where(present).groupBy(*[col(k) for k in keys])
            .agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1))


def unique_violations(df: DataFrame, column: str) -> DataFrame:
    """Repeated values of a unique column; NULL may repeat."""
    return pk_duplicates(df, [column])


def _column_counts(df: DataFrame, contract: Contract) -> tuple[list[Column], list[tuple]]:
    """Aggregates for the checks that need no shuffle, with their labels."""
    counts, labels = [], []
    for spec in contract.columns:
        if spec.name not in df.columns:
            continue
        if spec.required:
            counts.append(F.count(F.lit(1)) - F.count(col(spec.name)))
            labels.append((contract.table, "not_null", spec.name))
        if spec.max_length is not None:
            counts.append(F.count_if(F.char_length(col(spec.name)) > spec.max_length))
            labels.append((contract.table, "length", spec.name))
    return counts, labels


def column_violations(df: DataFrame, contract: Contract) -> DataFrame | None:
    """NULLs in required columns and over-long text, all in one pass; None if none declared."""
    counts, labels = _column_counts(df, contract)
    if not counts:
        return None
    one_row = df.agg(*[c.cast("long").alias(f"n{i}") for i, c in enumerate(counts)])
    return unpivot(one_row, labels, _LABELS,
                   [[F.col(f"n{i}").alias("violations")] for i in range(len(counts))])


def null_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """NULLs per required column."""
    return _only(column_violations(df, contract), "not_null")


def length_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Over-long values per varchar(n) / char(n) column."""
    return _only(column_violations(df, contract), "length")


def _only(found: DataFrame | None, constraint: str) -> DataFrame:
    if found is None:
        raise ValueError(f"the contract declares no {constraint} constraint")
    return found.where(F.col("constraint") == constraint)


def _repeats(df: DataFrame, table: str, constraint: str, keys: list[str]) -> DataFrame:
    repeats = pk_duplicates(df, keys).agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
    return _labelled(repeats, table, constraint, ",".join(keys))


def _labelled(counted: DataFrame, table: str, constraint: str, column: str) -> DataFrame:
    return counted.select(F.lit(table).alias("table"), F.lit(constraint).alias("constraint"),
                          F.lit(column).alias("column"), F.col("violations").cast("long"))


def table_violations(df: DataFrame, contract: Contract,
                     parents: dict[str, DataFrame] | None = None,
                     held: DataFrame | None = None) -> list[DataFrame]:
    """Check frames ``(table, constraint, column, violations)`` of one table.

    ``parents`` holds the referenced tables; references to others are not checked. ``held`` is
    what the target has already: new keys are compared with it rather than re-checking it.
    """
    parts = []
    columns = column_violations(df, contract)
    if columns is not None:
        parts.append(columns)
    groups = [("primary_key", contract.primary_key)] if contract.primary_key else []
    groups += [("unique", [name]) for name in contract.uniques]
    for constraint, keys in groups:
        if not all(k in df.columns for k in keys):
            continue
        parts.append(_repeats(df, contract.table, constraint, keys))
        if held is not None:
            clashes = key_conflicts(df, held, keys).agg(F.count(F.lit(1)).alias("violations"))
            parts.append(_labelled(clashes, contract.table, f"{constraint}_held", ",".join(keys)))
    for name, key in contract.foreign_keys:
        if name not in df.columns:
            continue
        if key.table == contract.table:
            # A self reference may point at rows of this load or at rows already there.
            parent = df.select(col(key.column))
            if held is not None:
                parent = parent.unionAll(held.select(col(key.column)))
        elif parents and key.table in parents:
            parent = parents[key.table]
        else:
            continue
        lost = fk_orphans(df, name, parent, key.column).agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("violations"))
        parts.append(_labelled(lost, contract.table, "foreign_key", name))
    return parts


def constraint_report(frames: dict[str, DataFrame], contracts: list[Contract]) -> DataFrame:
    """All declared constraints of all given tables: ``(table, constraint, column, violations)``."""
    parts = [
        part for contract in contracts if contract.table in frames
        for part in table_violations(frames[contract.table], contract, frames)
    ]
    if not parts:
        raise ValueError("the contracts declare nothing to check on the given tables")
    return reduce(DataFrame.unionAll, parts)


# What a row that a fused check emits counts as.
_BROKEN, _REPEATED, _CHILD = range(3)


def constraint_report_fused(frames: dict[str, DataFrame],
                            contracts: list[Contract]) -> DataFrame:
    """``constraint_report`` with one scan of each table and one shuffle for all of them.

    Each row emits the keys it has a say in, tagged with the number of the constraint: its own
    primary key and unique values, its references, the columns others refer to, and a keyless
    mark for each NULL or over-long text that breaks a rule. One aggregation counts, for every
    tagged key, the rows that hold it and the rows it may refer to; it begins in the scan's tasks,
    so a key that many rows share is one row for each task.
    """
    tables = [c for c in contracts if c.table in frames]
    labels: list[tuple] = []
    emitted: dict[str, list[Column]] = {c.table: [] for c in tables}

    def tag(table: str, constraint: str, column: str, kind: int) -> int:
        labels.append((len(labels), table, constraint, column, kind))
        return len(labels) - 1

    for contract in tables:
        df, out = frames[contract.table], emitted[contract.table]
        for spec in contract.columns:
            if spec.name not in df.columns:
                continue
            if spec.required:
                number = tag(contract.table, "not_null", spec.name, _BROKEN)
                out.append(F.when(col(spec.name).isNull(), _emit(number)))
            if spec.max_length is not None:
                number = tag(contract.table, "length", spec.name, _BROKEN)
                out.append(F.when(F.char_length(col(spec.name)) > spec.max_length, _emit(number)))
        groups = [("primary_key", contract.primary_key)] if contract.primary_key else []
        groups += [("unique", [name]) for name in contract.uniques]
        for constraint, keys in groups:
            if all(k in df.columns for k in keys):
                number = tag(contract.table, constraint, ",".join(keys), _REPEATED)
                out.append(emit_key(df, keys, number))
        for name, key in contract.foreign_keys:
            if name in df.columns and key.table in frames:
                number = tag(contract.table, "foreign_key", name, _CHILD)
                kinds = [df.schema[name].dataType, frames[key.table].schema[key.column].dataType]
                wide = _common_type(df.sparkSession, *kinds)
                out.append(emit_key(df, [name], number, wide))
                emitted.setdefault(key.table, []).append(
                    emit_key(frames[key.table], [key.column], number, wide, parent=True))
    if not labels:
        raise ValueError("the contracts declare nothing to check on the given tables")
    rows = [frames[t].select(F.explode(F.array_compact(F.array(*out))).alias("_e"))
            .select("_e.*") for t, out in emitted.items() if out]
    keys = (reduce(DataFrame.unionAll, rows).groupBy("number", "key")
            .agg(F.sum("held").alias("held"), F.sum("offered").alias("offered")))
    known = keys.sparkSession.createDataFrame(
        labels, "number int, table string, constraint string, column string, kind int")
    extra = (F.when(F.col("kind") == _BROKEN, F.col("held"))
             .when(F.col("kind") == _REPEATED, F.col("held") - 1)
             .when(F.col("offered") == 0, F.col("held")).otherwise(F.lit(0)))
    counted = (keys.join(F.broadcast(known.select("number", "kind")), "number")
               .groupBy("number").agg(F.sum(extra).alias("violations")))
    return known.join(F.broadcast(counted), "number", "left").select(
        *_LABELS, F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


def _emit(number: int, key: Column | None = None, parent: bool = False) -> Column:
    return F.struct(F.lit(number).alias("number"),
                    (F.lit(None).cast("string") if key is None else key).alias("key"),
                    F.lit(0 if parent else 1).cast("long").alias("held"),
                    F.lit(1 if parent else 0).cast("long").alias("offered"))


def emit_key(df: DataFrame, keys: list[str], number: int, as_type: T.DataType | None = None,
              parent: bool = False) -> Column:
    """The tagged key of a row that has one, as text that is equal only for equal keys."""
    present = reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])
    parts = []
    for k in keys:
        kind = as_type or df.schema[k].dataType
        value = col(k).cast(kind)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            value = value + F.lit(0).cast(kind)  # zero has one sign
        if isinstance(kind, T.BinaryType):
            value = F.hex(value)
        parts.append(value.cast("string"))
    if len(parts) > 1:  # lengths keep apart what would run together
        parts = [p for text in parts for p in (F.char_length(text).cast("string"), F.lit(":"),
                                               text)]
    return F.when(present, _emit(number, F.concat(*parts), parent))


def _common_type(spark: SparkSession, child: T.DataType, parent: T.DataType) -> T.DataType:
    """The type Spark compares two columns in."""
    if child == parent:
        return child
    empty = spark.createDataFrame([], T.StructType([T.StructField("a", child),
                                                    T.StructField("b", parent)]))
    return empty.select(F.coalesce("a", "b").alias("c")).schema["c"].dataType


def require(parts: list[DataFrame]) -> None:
    """Raise if any check found a violation."""
    if not parts:
        return
    broken = reduce(DataFrame.unionAll, parts).where("violations > 0")
    # One row per declared constraint at most.
    found = [row.asDict() for row in broken.collect()]
    if found:
        raise ConstraintError(found)
