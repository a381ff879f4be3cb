"""Session settings the library is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Row-group statistics only exist for instants written this way; marks rely on them.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.sources.partitionOverwriteMode": "static",
}

# Shuffled bytes one task should handle.
TASK_BYTES = 128 * 1024**2


def sized_settings(shuffle_bytes: int, cores: int) -> dict[str, str]:
    """Shuffle settings for a job that moves ``shuffle_bytes``.

    What is shuffled are keys and deltas, not whole tables: estimate those. Starting with enough
    partitions keeps each within memory; adaptive execution merges the small ones afterwards.
    """
    partitions = max(2 * cores, -(-shuffle_bytes // TASK_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        # Huge tables: bigger scan splits mean fewer tasks and fewer files written.
        "spark.sql.files.maxPartitionBytes": str(
            4 * TASK_BYTES if partitions > 10 * cores else TASK_BYTES),
    }


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
