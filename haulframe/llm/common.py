"""Shared pieces: words, staging, gapless positions within skewed groups."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulframe.sources.storage import Staged, stage

__all__ = ["Staged", "documents", "literal_array", "positions", "stage", "unpacked", "whole_row",
           "whole_text"]

# ASCII white space; every other code point belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

# Rows that share a bucket when positions are computed, and buckets that share a block.
BUCKET_ROWS = 64
BLOCK_BUCKETS = 1024


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def whole_row(docs: DataFrame, name: str = "_row") -> Column:
    """All columns as one struct, so that their names meet no others."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias(name)


def unpacked(docs: DataFrame, name: str = "_row") -> list[Column]:
    """The columns of ``whole_row`` again."""
    return [F.col(name).getField(c).alias(c) for c in docs.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal_array(values: Sequence[int | float], kind: str) -> Column:
    """A constant array; ``kind`` is ``bigint`` or ``double``. One text literal, which Spark folds
    into an array while planning, is planned much faster than an expression for each value."""
    text = ",".join(repr(float(v)) if kind == "double" else str(int(v)) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{kind}>")


def positions(df: DataFrame, group: str, counts: Sequence[int], order: Sequence[str],
              weight: Column, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows before this one in its group.

    ``group`` holds integers from 0 and ``counts`` their rows. Rows are ordered by a hash of
    ``order``; a group is cut into buckets by that hash, so no task holds a whole group, however
    many rows it has: sums run within buckets, over the buckets of a block, and over the blocks
    of a group (one row for each 65,536 rows). ``df`` is read twice and should be staged. Rows
    that agree in ``order`` go by ``ties``.
    """
    buckets = [max(1, -(-int(n) // BUCKET_ROWS)) for n in counts] or [1]
    h = F.xxhash64(*[F.col(c) for c in order])
    keyed = (df.withColumn("_h", h).withColumn("_w", weight.cast("long"))
             .withColumn("_bucket", F.pmod(F.col("_h"),
                         F.element_at(literal_array(buckets, "bigint"),
                                      F.col(group).cast("int") + 1)))
             .withColumn("_block", F.floor(F.col("_bucket") / BLOCK_BUCKETS)))
    by_bucket = keyed.groupBy(group, "_block", "_bucket").agg(F.sum("_w").alias("_s"))
    by_block = by_bucket.groupBy(group, "_block").agg(F.sum("_s").alias("_t"))
    blocks = by_block.select(group, "_block", before(F.col("_t"), [group], ["_block"])
                             .alias("_block_start"))
    starts = (by_bucket.join(blocks, [group, "_block"])
              .select(group, "_bucket",
                      (F.col("_block_start") + before(F.col("_s"), [group, "_block"],
                                                      ["_bucket"])).alias("_bucket_start")))
    joined = keyed.join(starts, [group, "_bucket"])
    place = F.col("_bucket_start") + before(F.col("_w"), [group, "_bucket"], ["_h", *order, *ties])
    return joined.withColumn(out, place).drop("_h", "_w", "_bucket", "_block", "_bucket_start")


# A group with over a thousandth of all rows is joined by broadcast: there are at most 1,000.
HOT_PART = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with their group, unique by ``key``, of ``size`` of the ``total`` rows.

    Groups with over a thousandth of all rows, at most 1,000, are broadcast, so no task of the
    join for the others gets more. ``groups`` and ``rows`` are read twice and should be staged.
    """
    large = F.col(size) * HOT_PART > total
    hot = rows.join(F.broadcast(groups.filter(large).withColumn("_hot", F.lit(True))), key, "left")
    cold = (hot.filter(F.col("_hot").isNull()).select(*rows.columns)
            .join(groups.filter(~large), key))
    columns = [*rows.columns, *[c for c in groups.columns if c != key]]
    return hot.filter(F.col("_hot")).select(*columns).unionByName(cold.select(*columns))


def before(value: Column, keys: list[str], order: list[str]) -> Column:
    """Sum of ``value`` over the earlier rows of the window."""
    window = (Window.partitionBy(*keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.sum(value).over(window), F.lit(0).cast("long"))


# Bytes of text handed to Python at once.
ARROW_BYTES = 4 * 1024**2


# Workers stay between tasks; with these they return freed memory to the machine.
GIVE_BACK = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1",
             "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_MMAP_THRESHOLD_": "131072"}


# By their numbers in mallopt: free bytes at the heap's end from which they go back, and sizes from
# which an array gets pages of its own.
_TRIM, _MAP = -1, -3


def keep_freed(trim: int = 32 * 1024**2, own_pages: int = 8 * 1024**2) -> None:
    """For work on arrays of some megabytes: up to ``trim`` freed bytes stay with the worker, as
    new pages for each array cost more time than most work on it. ``return_freed`` undoes this."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(_TRIM, trim)
        mallopt(_MAP, own_pages)


def return_freed() -> None:
    keep_freed(*[int(os.environ.get(name, GIVE_BACK[name])) for name in
                 ("MALLOC_TRIM_THRESHOLD_", "MALLOC_MMAP_THRESHOLD_")])


_holder = {"name": "", "release": lambda: None}


def take_over(name: str, release: Callable[[], None] = lambda: None) -> None:
    """Called in a worker before an operator works there: what another one kept between its tasks
    goes back to the machine, as workers serve all operators of a session in turn."""
    if _holder["name"] == name:
        return
    _holder["release"]()
    _holder.update(name=name, release=release)
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def prepare_python(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Bound what Python workers get at once, and let them import this package.

    Arrow batches are bounded by bytes unless the session has a tighter bound: rows are counted
    too, but 10,000 very long texts do not fit in a Python worker. The package's folder is added
    to the workers' path, for executors that see it; elsewhere it is shipped with the job.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key).removesuffix("b")
    if given.isdigit() and int(given) > most:
        spark.conf.set(key, str(most))
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    for name, value in GIVE_BACK.items():
        environment.setdefault(name, value)
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
