"""Foreign keys as joins.

Child rows can be many and their keys uneven, so only distinct keys are shuffled: each side is
reduced to its keys first (a partial aggregate, so a hot key costs one row per task). Rows are
then picked by broadcasting the small set of offending keys, after measuring it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from haulframe.contract import Contract
from haulframe.functions.names import col
from haulframe.sources.storage import Staged, stage

# A key is hot when it has more than one in this many rows, so there are fewer hot keys than this.
HOT_SHARE = 1000
# Name of a key column that cannot clash with the rows' own columns.
PICK = "__key"


def key_usage(child: DataFrame, column: str) -> DataFrame:
    """``(key, rows)`` of the non-NULL child keys."""
    return (child.where(col(column).isNotNull())
            .groupBy(col(column).alias("key")).agg(F.count(F.lit(1)).alias("rows")))


def _parent_keys(parent: DataFrame, column: str) -> DataFrame:
    return parent.select(col(column).alias("parent_key")).distinct()


def fk_orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child keys that no parent has, with how many rows use them. A NULL key is no orphan."""
    usage, keys = key_usage(child, column), _parent_keys(parent, parent_column)
    return usage.join(keys, F.col("key") == F.col("parent_key"), "left_anti")


def fk_valid_rows(child: DataFrame, column: str, parent: DataFrame,
                  parent_column: str) -> DataFrame:
    """Rows a keyed target would accept: key found in the parent, or NULL."""
    return _pick(child, column, _staged_orphans(child, column, parent, parent_column), "left_anti")


def fk_invalid_rows(child: DataFrame, column: str, parent: DataFrame,
                    parent_column: str) -> DataFrame:
    """Rows a keyed target would reject."""
    return _pick(child, column, _staged_orphans(child, column, parent, parent_column), "left_semi")


def _staged_orphans(child: DataFrame, column: str, parent: DataFrame,
                    parent_column: str) -> Staged:
    orphans = fk_orphans(child, column, parent, parent_column)
    return stage(orphans.select(F.col("key").alias(PICK)), "orphans")


def _pick(rows: DataFrame, column: str, keys: Staged, how: str) -> DataFrame:
    """``rows`` whose key is in (left_semi) or not in (left_anti) a staged set of distinct keys."""
    on = col(column) == F.col(PICK)
    if keys.broadcastable:
        return rows.join(F.broadcast(keys.df), on, how)
    # NULL is no orphan; its rows must not meet in one task of the shuffle.
    unkeyed = rows.where(col(column).isNull())
    rows = rows.where(col(column).isNotNull())
    # Too many keys to broadcast: shuffle the rows, but keep hot keys out of the shuffle. There
    # are fewer than HOT_SHARE of those, so their verdicts always fit a broadcast.
    usage = stage(key_usage(rows, column), "usage").df
    total = usage.agg(F.sum("rows")).first()[0] or 0
    hot = usage.where(F.col("rows") * HOT_SHARE > total)
    hot = stage(hot.select(F.col("key").alias(PICK)), "hot").df
    hot_hits = stage(hot.join(keys.df, PICK, "left_semi"), "hot_hits").df
    cold_rows = rows.join(F.broadcast(hot), on, "left_anti")
    hot_rows = rows.join(F.broadcast(hot), on, "left_semi")
    picked = cold_rows.join(keys.df, on, how).unionAll(
        hot_rows.join(F.broadcast(hot_hits), on, how))
    return picked.unionAll(unkeyed) if how == "left_anti" else picked


def fk_report(frames: dict[str, DataFrame], contracts: list[Contract]) -> DataFrame:
    """Every declared reference with its orphan rows:
    ``(child, column, parent, parent_column, orphan_rows)``."""
    parts = []
    for contract in contracts:
        for column, key in contract.foreign_keys:
            if contract.table not in frames or key.table not in frames:
                continue
            orphans = fk_orphans(frames[contract.table], column, frames[key.table], key.column)
            parts.append(orphans.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"))
                         .select(F.lit(contract.table).alias("child"),
                                 F.lit(column).alias("column"), F.lit(key.table).alias("parent"),
                                 F.lit(key.column).alias("parent_column"), "orphan_rows"))
    if not parts:
        raise ValueError("no reference between the given tables")
    return reduce(DataFrame.unionAll, parts)


def key_conflicts(delta: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``delta`` that ``target`` already holds.

    The delta's keys are measured; a small set is broadcast, so the target is scanned once and
    never shuffled. A single orderable key also bounds that scan by its smallest and largest
    value, which prunes files by their statistics.
    """
    new = delta.select(*[col(k) for k in keys])
    new = stage(new.where(_all_present(keys)).distinct(), "new_keys")
    held = target.select(*[col(k).alias(f"__held_{i}") for i, k in enumerate(keys)])
    if new.broadcastable:
        if len(keys) == 1:
            held = _between(held, new.df, keys[0])
        hits = held.join(F.broadcast(new.df), _same(keys), "left_semi").distinct()
        return hits.select(*[F.col(f"__held_{i}").alias(k) for i, k in enumerate(keys)])
    return new.df.join(held.distinct(), _same(keys), "left_semi")


def _between(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    data_type = new.schema[key].dataType
    low, high = new.agg(F.min(col(key)).cast("string"), F.max(col(key)).cast("string")).first()
    if low is None or data_type.typeName() not in (
            "long", "integer", "short", "byte", "decimal", "date", "timestamp_ntz", "string"):
        return held
    return held.where(F.col("__held_0").between(F.lit(low).cast(data_type),
                                              F.lit(high).cast(data_type)))


def _all_present(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(k) == F.col(f"__held_{i}") for i, k in enumerate(keys)])
