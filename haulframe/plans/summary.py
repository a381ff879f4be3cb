"""Counts over contracts and the rows their tables hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulframe.contract import Contract

COLUMNS = ("schema string, table string, column string, position int, primary_key boolean, "
           "foreign_key boolean, is_unique boolean, required boolean")


def contract_rows(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """One row per declared column."""
    return spark.createDataFrame([
        (c.target_schema(), c.table, s.name, i + 1, s.primary_key, s.foreign_key is not None,
         s.unique, s.required)
        for c in contracts for i, s in enumerate(c.columns)
    ], COLUMNS)


def contract_summary(spark: SparkSession, contracts: list[Contract],
                     frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per table: columns, keys and, where its frame is given, rows held."""
    counted = contract_rows(spark, contracts).groupBy("schema", "table").agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if("primary_key").alias("primary_keys"),
        F.count_if("foreign_key").alias("foreign_keys"),
        F.count_if("is_unique").alias("uniques"),
        F.count_if("required").alias("required"),
    )
    if not frames:
        return counted
    held = reduce(DataFrame.unionAll, [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in frames.items()
    ])
    return counted.join(held, "table", "left")
