"""Comparing a target with its source by digests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from haulframe.functions.names import col
from haulframe.sources.storage import stage

# Buckets of keys that are compared; one row for each on both sides.
BUCKETS = 4096


def reconcile_by_digest(source: DataFrame, target: DataFrame, keys: Sequence[str],
                        columns: Sequence[str] | None = None,
                        buckets: int = BUCKETS) -> DataFrame:
    """Keys whose rows differ between source and target: the keys, ``status``, ``source_rows``
    and ``target_rows``.

    ``status`` is ``missing`` (only the source has the key), ``extra`` (only the target) or
    ``changed`` (other values, or another number of rows). Keys match null-safely. ``columns``
    are compared besides the keys: all that both sides have, unless given.

    Rows are dealt into buckets by a hash of their key. Each side is reduced to one digest for
    each bucket, whatever the order of its rows: their number and two sums of independent 64-bit
    hashes. Only buckets whose digests differ are read again, and only those rows shuffled, so
    sides that agree cost one scan each and a shuffle of ``buckets`` rows for each task.
    """
    if columns is None:
        columns = [c for c in source.columns if c in target.columns and c not in keys]
    both = [_dealt(df, keys, columns, buckets) for df in (source, target)]
    digests = [df.groupBy("bucket").agg(*_digest(f"{side}_"))
               for df, side in zip(both, ("source", "target"))]
    same = [F.col(f"source_{p}").eqNullSafe(F.col(f"target_{p}")) for p in ("rows", "a", "b")]
    unlike = stage(digests[0].join(digests[1], "bucket", "full")
                   .filter(~reduce(lambda x, y: x & y, same)).select("bucket"), "unlike").df
    names = [f"key_{i}" for i in range(len(keys))]
    # At most ``buckets`` rows, so they are broadcast.
    again = [df.join(F.broadcast(unlike), "bucket", "left_semi")
             .groupBy(*names).agg(*_digest(f"{side}_"))
             for df, side in zip(both, ("source", "target"))]
    right = again[1].select(*[F.col(n).alias(f"held_{n}") for n in names],
                            *[c for c in again[1].columns if c not in names])
    met = again[0].join(right, [F.col(n).eqNullSafe(F.col(f"held_{n}")) for n in names], "full")
    status = (F.when(F.col("target_rows").isNull(), "missing")
              .when(F.col("source_rows").isNull(), "extra").otherwise("changed"))
    found = met.filter(~reduce(lambda x, y: x & y, same))
    # A key of NULLs on one side only is told by the side's count, not by the key itself.
    here = F.col("source_rows").isNotNull()
    return found.select(
        *[F.when(here, F.col(n)).otherwise(F.col(f"held_{n}")).alias(k)
          for n, k in zip(names, keys)],
        status.alias("status"),
        *[F.coalesce(f"{side}_rows", F.lit(0)).cast("long").alias(f"{side}_rows")
          for side in ("source", "target")])


def _dealt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int) -> DataFrame:
    """key_0, ..., bucket and the two hashes of each row."""
    values = [_plain(df, c) for c in (*keys, *columns)]
    # A hash skips NULLs, so their places are hashed as well.
    nulls = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
    return df.select(
        *[col(k).alias(f"key_{i}") for i, k in enumerate(keys)],
        F.pmod(F.xxhash64(*[_plain(df, k) for k in keys]), F.lit(buckets)).alias("bucket"),
        F.xxhash64(nulls, *values).alias("a"),
        F.xxhash64(F.lit("second"), *reversed(values), nulls).alias("b"))


def _plain(df: DataFrame, name: str) -> Column:
    """A column a hash can take: maps as their sorted entries, integers in one width."""
    kind = df.schema[name].dataType.typeName()
    if kind == "map":
        return F.to_json(F.array_sort(F.map_entries(col(name))))
    if kind in ("byte", "short", "integer"):
        return col(name).cast("long")
    if kind in ("char", "varchar"):
        return col(name).cast("string")
    return col(name)


def _digest(prefix: str) -> list[Column]:
    sums = [F.sum(F.col(c).cast("decimal(20,0)")).alias(f"{prefix}{c}") for c in ("a", "b")]
    return [F.count(F.lit(1)).alias(f"{prefix}rows"), *sums]
