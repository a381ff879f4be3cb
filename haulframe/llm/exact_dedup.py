"""Exact dedup (operator 10): streaming state keyed by digest, checked on full bytes.

The documents are staged once with a row id, the text without white space, and its digest. A
Structured Streaming aggregation over the staged keys keeps, for every digest and without expiry,
the row that stays (code points, stable id, content locator) and the number of rows. Its state
lives in RocksDB on disk and is checkpointed to the shared folder, so it survives lost executors
and more input can follow. The decisions are read from that state. Every hit (a row whose digest
another row holds) is then compared with the kept row on the whole normalised text; rows that
differ although their digests agree are grouped again by their text.

Main path: DataFrame functions only.

Defined cases: NULL text counts as empty, and all empty texts form one group; NULL ids sort last;
rows repeated with the same id are separate rows of which one stays; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulframe.llm.common import (
    SPACE,
    join_groups,
    stage,
    unpacked,
    whole_row,
    whole_text,
)
from haulframe.sources.storage import scratch_path

# Rows of one group that are compared with one copy of the kept row's text.
COPY_ROWS = 512

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Executors give back a store's memory as soon as a batch is committed.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # Reserved blocks would take 4 MB and more for each of many small stores.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def sha256_key(text: Column) -> Column:
    """Digest of the normalised text."""
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256_key) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256.

    ``digest`` keys the state; a weak one costs time, not correctness.
    """
    rows = stage(_keyed(docs, id_col, text_col, digest), "dedup-rows").df
    return _decided(rows).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", "kept",
        F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = stage(_keyed(docs, id_col, text_col, sha256_key, [whole_row(docs)]), "dedup-rows").df
    gone = _decided(rows.withColumn("_text", F.col("_row").getField(text_col)))
    gone = stage(gone.filter(~F.col("kept")).select("_uid"), "copies")
    dropped = F.broadcast(gone.df) if gone.broadcastable else gone.df
    return rows.join(dropped, "_uid", "left_anti").select(*unpacked(docs))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest, kept=None) -> DataFrame:
    """Row id, id, code points, digests, and the text or what else is to be kept."""
    text = whole_text(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("_uid"), F.col(id_col).cast("long").alias("_id"),
        F.length(text).cast("long").alias("_points"), *(kept or [text.alias("_text")]),
        normalised(text).alias("_norm"))
    rows = rows.withColumn("_key", digest(F.col("_norm")))
    sha = F.col("_key") if digest is sha256_key else sha256_key(F.col("_norm"))
    return rows.withColumn("_sha", sha).drop("_norm")


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    earlier = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in earlier.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def advance_state(spark: SparkSession, keys_dir: str, schema, state_dir: str) -> DataFrame:
    """Feed the files in ``keys_dir`` that are new to the state in ``state_dir``; read the state.

    Columns of the files: _uid, _id, _points, _key. Returns _key, keeper (points, id, uid) and
    group_size for every digest seen so far. Run again after more files came, it reads only those.
    """
    arrivals = spark.readStream.schema(schema).parquet(keys_dir)
    best = F.max(F.struct(
        F.col("_points").alias("points"),
        F.coalesce(F.bitwise_not("_id"), F.lit(-2**63)).alias("rank"),
        F.bitwise_not("_uid").alias("row"), F.col("_id").alias("id")))
    state = arrivals.groupBy("_key").agg(best.alias("keeper"),
                                         F.count(F.lit(1)).alias("group_size"))
    with _settings(spark, STATE_SETTINGS):
        run = (state.writeStream.outputMode("update").format("noop")
               .option("checkpointLocation", state_dir).trigger(availableNow=True).start())
        run.awaitTermination()
        return (spark.read.format("statestore").load(state_dir)
                .select(F.col("key._key").alias("_key"),
                        F.col("value").getField("max").alias("keeper"),
                        F.col("value").getField("count").alias("group_size")))


def _decided(rows: DataFrame) -> DataFrame:
    """_uid, _id, _sha, keep_id, group_size, kept for every staged row."""
    spark = rows.sparkSession
    keys = stage(rows.select("_uid", "_id", "_points", "_key", "_sha"), "dedup-keys")
    if not keys.rows:
        return keys.df.select("_uid", "_id", "_sha", F.col("_id").alias("keep_id"),
                              F.lit(1).cast("long").alias("group_size"),
                              F.lit(True).alias("kept"))
    state = advance_state(spark, keys.df.inputFiles()[0].rpartition("/")[0],
                          keys.df.schema, scratch_path(spark, "dedup-state"))
    with _settings(spark, STATE_SETTINGS):  # readers of the state are bounded as its writers
        groups = stage(state.select("_key", F.col("keeper.id").alias("keep_id"),
                                    F.bitwise_not(F.col("keeper.row")).alias("_keep_uid"),
                                    "group_size"), "dedup-groups").df
    decided = stage(join_groups(keys.df, groups, "_key", "group_size", keys.rows)
                    .withColumn("kept", F.col("_uid") == F.col("_keep_uid")), "dedup-decided").df
    return _rechecked(rows, decided)


def _rechecked(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Compare every hit with the kept row on all bytes; group those that differ by their text."""
    hits = stage(decided.filter(F.col("group_size") > 1)
                 .select("_uid", "_keep_uid", "group_size", "kept"), "dedup-hits")
    few = F.broadcast(hits.df) if hits.broadcastable else hits.df
    # Normalised again after the join, for the hits alone.
    texts = (rows.select("_uid", "_id", "_points", "_text").join(few, "_uid")
             .withColumn("_norm", normalised(F.col("_text"))).drop("_text"))
    copies = F.ceil(F.col("group_size") / COPY_ROWS).cast("int")
    kept = (texts.filter("kept")
            .select(F.col("_uid").alias("_keep_uid"), F.col("_norm").alias("_kept_norm"),
                    F.explode(F.sequence(F.lit(0), copies - 1)).alias("_copy")))
    others = (texts.filter(~F.col("kept"))
              .withColumn("_copy", F.pmod(F.xxhash64("_uid"), copies).cast("int")))
    unlike = stage(others.join(kept, ["_keep_uid", "_copy"])
                   .filter(F.col("_norm") != F.col("_kept_norm"))
                   .select("_uid", "_id", "_points", "_norm", "_keep_uid"), "dedup-unlike")
    columns = ["_uid", "_id", "_sha", "keep_id", "group_size", "kept"]
    if not unlike.rows:
        return decided.select(*columns)
    best = Window.partitionBy("_norm", "_keep_uid")
    order = best.orderBy(F.desc("_points"), F.col("_id").asc_nulls_last(), "_uid")
    anew = unlike.df.select(
        "_uid", F.first("_id").over(order).alias("_new_keep"),
        F.count(F.lit(1)).over(best).alias("_new_size"),
        (F.row_number().over(order) == 1).alias("_new_kept"))
    fewer = unlike.df.groupBy("_keep_uid").agg(F.count(F.lit(1)).alias("_less"))
    joined = decided.join(anew, "_uid", "left").join(fewer, "_keep_uid", "left")
    moved = F.col("_new_size").isNotNull()
    return joined.select(
        "_uid", "_id", "_sha",
        F.when(moved, F.col("_new_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(moved, F.col("_new_size")).otherwise(
            F.col("group_size") - F.coalesce("_less", F.lit(0))).alias("group_size"),
        F.when(moved, F.col("_new_kept")).otherwise(F.col("kept")).alias("kept"))
