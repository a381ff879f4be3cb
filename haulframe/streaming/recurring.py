"""A recurring incremental load as a file stream.

The stream's checkpoint remembers which files were loaded, so rows that tie with the newest mark
are not lost. The schedule itself stays outside: each run takes what is new and stops.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from haulframe.contract import Contract
from haulframe.operators.checks import require, table_violations
from haulframe.plans.load import LoadOptions, shaped
from haulframe.sources.storage import Storage
from haulframe.sources.tables import PathTable


def read_arrivals(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  files_per_batch: int | None = None) -> DataFrame:
    """Stream of the files that arrive in a folder (or of one file)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if not Storage(spark, path).is_dir(path):
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def stream_id(batch: DataFrame, checkpoint: str) -> str:
    """The id of the stream a batch comes from: one for each checkpoint, the same in every run."""
    spark = batch.sparkSession
    own = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if own:
        return own
    metadata = spark.read.text(f"{checkpoint}/metadata").first()
    return json.loads(metadata[0])["id"]


def load_arrivals(arrivals: DataFrame, target: PathTable, checkpoint: str,
                  options: LoadOptions = LoadOptions(), name: str = "arrivals",
                  contract: Contract | None = None) -> StreamingQuery:
    """Append everything new to the target, then stop. Each batch lands exactly once.

    The target's ledger knows batches by the stream's own id, which its checkpoint keeps, and
    their number: streams with checkpoints of their own never take each other's batches for
    replays. ``name`` only words messages. The options do what they
    do in ``load_table``; ``conform`` and ``enforce`` go by ``contract``, or the target's own. A
    batch that is refused lands nowhere and fails the query, and is tried again by the next run.
    """
    contract = contract or target.contract

    def append(batch: DataFrame, batch_id: int) -> None:
        rows, checked = shaped(batch, target.target_schema(), contract, options, name,
                               target.enforces_keys, True)
        if checked:
            require(table_violations(rows, contract, None, target.held()))
        target.append_batch(rows, f"{stream_id(batch, checkpoint)}-{batch_id}")

    return (arrivals.writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_arrivals(arrivals: DataFrame, target: PathTable, checkpoint: str,
                 options: LoadOptions = LoadOptions(), name: str = "arrivals",
                 contract: Contract | None = None) -> None:
    """``load_arrivals``, waiting until it is done; a failed batch raises."""
    load_arrivals(arrivals, target, checkpoint, options, name, contract).awaitTermination()
