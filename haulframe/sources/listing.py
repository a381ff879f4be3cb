"""What tables a source holds, and what columns they have."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulframe.contract import Contract, contract_of, labels_of, merge_described
from haulframe.functions.names import col, quoted
from haulframe.functions.types import contract_type_of
from haulframe.operators.conform import unpivot
from haulframe.sources.connection import LAKES, SYSTEM_SCHEMAS, Connection
from haulframe.sources.storage import Storage
from haulframe.sources.metadata import with_facts
from haulframe.sources.tables import JdbcTable, Table, open_table

LISTED = "schema string, table string"


def list_tables(spark: SparkSession, connection: Connection) -> DataFrame:
    """Base tables as ``(schema, table)``, system schemas left out, in name order."""
    if connection.is_lake:
        found = _list_folders(spark, connection)
    else:
        catalog = quoted(connection.catalog(spark))
        found = []
        for namespace in spark.sql(f"SHOW NAMESPACES IN {catalog}").collect():
            schema = namespace[0].strip("`")
            if schema.lower() in SYSTEM_SCHEMAS.get(connection.kind, ()):
                continue
            shown = spark.sql(f"SHOW TABLES IN {catalog}.{quoted(schema)}").collect()
            found += [(schema, row["tableName"]) for row in shown]
    return spark.createDataFrame(sorted(found), LISTED)


def list_catalog_tables(spark: SparkSession, namespace: str) -> DataFrame:
    """Tables of a session-catalog namespace; temporary views do not count."""
    found = [(namespace, t.name) for t in spark.catalog.listTables(namespace) if not t.isTemporary]
    return spark.createDataFrame(sorted(found), LISTED)


def _list_folders(spark: SparkSession, connection: Connection) -> list[tuple[str, str]]:
    base = connection.warehouse
    storage = Storage(spark, base)
    if not storage.exists(base):
        return []
    schema = base.rstrip("/").rsplit("/", 1)[-1]
    delta = LAKES[connection.kind] == "delta"
    return [
        (schema, name) for name in storage.list(base)
        if not name.startswith((".", "_")) and storage.is_dir(f"{base}/{name}")
        and (not delta or storage.exists(f"{base}/{name}/_delta_log"))
    ]


def describe(table: str, source: Table | DataFrame, schema: str | None = None) -> Contract:
    """Contract a live table implies: its columns, and what a database tells about keys,
    uniques, references and defaults."""
    struct = source.schema if isinstance(source, DataFrame) else source.columns()
    implied = contract_of(table, struct, schema)
    if isinstance(source, JdbcTable):
        implied = replace(implied, columns=with_facts(implied.columns, source.facts()))
    return implied


def describe_missing(spark: SparkSession, connection: Connection, contracts: list[Contract],
                     only: str | None = None) -> list[Contract]:
    """Contracts with columns filled in from the source.

    Only tables without columns are described, or just ``only``, which is always described
    afresh. Keys the user set stay. A table that cannot be read keeps its place, undescribed.
    """
    described = []
    for label, contract in zip(labels_of(contracts), contracts, strict=True):
        wanted = label == only if only else not contract.columns
        if wanted:
            try:
                live = open_table(spark, connection, contract.table, source=True)
                contract = merge_described(
                    contract, describe(contract.table, live, contract.schema))
            except Exception as problem:  # one unreadable table must not stop the others
                warnings.warn(f"could not describe {contract.table}: {problem}", stacklevel=2)
        described.append(contract)
    return described


def describe_rows(table: str, df: DataFrame) -> DataFrame:
    """Columns of a table with what its rows show: ``(table, position, column, type,
    row_count, null_count)``.

    One pass; NULLs are counted as rows minus values.
    """
    fields = df.schema.fields
    counted = df.agg(F.count(F.lit(1)).alias("all"),
                     *[F.count(col(f.name)).alias(f"n{i}") for i, f in enumerate(fields)])
    labels = [(table, i + 1, f.name, contract_type_of(f)) for i, f in enumerate(fields)]
    return unpivot(counted, labels, ("table", "position", "column", "type"), [
        [F.col("all").alias("row_count"), (F.col("all") - F.col(f"n{i}")).alias("null_count")]
        for i in range(len(fields))
    ])
