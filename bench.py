"""Headline workloads at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each load workload is warmed up once and then timed three times; the median counts. Registered
queries are warmed up and timed once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import haulframe as hf  # noqa: E402
from catalogue.contracts import contract, frame, given  # noqa: E402
from catalogue.spark_queries import CUTOFF, QUERIES, at_or_before  # noqa: E402
from haulframe.sources.storage import scratch_path  # noqa: E402

RUNS = 3
# Registered queries timed as they are, on top of the load workloads below.
REGISTERED = ("incremental_load", "full_load", "load_all", "fk_valid_rows", "pk_conflicts",
              "constraint_report", "nested_to_json", "conform_types", "stream_incremental_load",
              "layout_partitioned")


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
               .config("spark.sql.shuffle.partitions", cpus)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="bench-")))
    for key, value in hf.SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work, prepare=lambda: None, runs: int = RUNS) -> float:
    """Median seconds of ``work(prepare())``; preparation is not timed."""
    seconds = []
    for i in range(runs + 1):
        state = prepare()
        start = time.perf_counter()
        work(state)
        if i:
            seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def workloads(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    spec = hf.LoadSpec("incremental", "o_orderdate")
    orders, lineitem = given(spark, sf_dir, "orders"), given(spark, sf_dir, "lineitem")
    documents = frame(spark, sf_dir, "documents")
    declared = hf.Contract.from_dict({"table": "documents", "columns": [
        {"name": "doc_id", "type": "bigint", "primary_key": True},
        {"name": "text", "type": "varchar(255)", "nullable": False},
        {"name": "lang", "type": "char(2)", "nullable": False},
    ]})

    def target(name: str) -> hf.PathTable:
        return hf.PathTable(spark, scratch_path(spark, name))

    def older() -> hf.PathTable:
        table = target("orders")
        table.append(at_or_before(orders.read(), "o_orderdate", CUTOFF))
        return table

    def current() -> hf.PathTable:
        table = target("orders")
        table.append(orders.read())
        return table

    return {
        "load_full_lineitem": timed(
            lambda t: hf.load_table(lineitem, t, contract("lineitem")),
            lambda: target("lineitem")),
        "load_incremental_orders": timed(
            lambda t: hf.load_table(orders, t, spec=spec), older),
        "load_incremental_orders_empty": timed(
            lambda t: hf.load_table(orders, t, spec=spec), current),
        "check_primary_key_lineitem": timed(lambda _: run(
            hf.pk_duplicates(lineitem.read(), ["l_orderkey", "l_linenumber"]))),
        "check_foreign_key_lineitem_orders": timed(lambda _: run(
            hf.fk_orphans(lineitem.read(), "l_orderkey", orders.read(), "o_orderkey"))),
        "check_null_and_length_documents": timed(lambda _: run(
            hf.length_violations(documents, declared))),
        "export_copy_documents": timed(
            lambda path: hf.write_copy_text(documents, path),
            lambda: scratch_path(spark, "copy")),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    seconds = workloads(spark, sf_dir)
    for name in REGISTERED:
        seconds[name] = timed(lambda _: run(QUERIES[name](spark, sf_dir)), runs=1)
    rows = frame(spark, sf_dir, "lineitem").count()
    copied = frame(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0]
    print(json.dumps({
        "metric": "total seconds of the headline workloads",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1],
        "rates": {
            "load_full_lineitem_rows_per_sec": round(rows / seconds["load_full_lineitem"]),
            "export_copy_documents_mb_per_sec": round(
                copied / 1e6 / seconds["export_copy_documents"], 1),
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
