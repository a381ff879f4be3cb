"""Creating targets from contracts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from haulframe.contract import ColumnSpec, Contract
from haulframe.functions.defaults import default_sql, is_generated
from haulframe.functions.names import quoted
from haulframe.functions.types import table_type
from haulframe.sources.tables import GENERATED, CatalogTable, JdbcTable, PathTable, Table


def create_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    at = " LOCATION '{}'".format(location.replace("'", "\\'")) if location else ""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {quoted(name)}{at}")


def namespaces_of(contracts: list[Contract], default: str | None = None) -> list[str]:
    """Namespaces the contracts write to, first seen first."""
    return list(dict.fromkeys(c.target_schema(default) for c in contracts))


def _column_clause(spec: ColumnSpec) -> str:
    clause = f"{quoted(spec.name)} {table_type(spec.type)}"
    if spec.required:
        clause += " NOT NULL"
    if spec.has_default and not _filled_at_load(spec):
        clause += f" DEFAULT {_sql(spec)}"
    return clause


def _filled_at_load(spec: ColumnSpec) -> bool:
    """Spark needs a default it can evaluate while planning, which a random id is not."""
    return spec.has_default and is_generated(spec.default) and "uuid" in _sql(spec)


def _sql(spec: ColumnSpec) -> str:
    text = str(spec.default).strip().lower()
    if text in ("newid()", "gen_random_uuid()", "uuid()"):
        return "uuid()"
    return default_sql(spec.default)


def create_statement(contract: Contract, name: str, fmt: str = "parquet",
                     bucket_by: tuple[str, ...] = (), buckets: int = 0) -> str:
    """``bucket_by`` deals rows into ``buckets`` by a hash of those columns, sorted by the
    contract's order in each; tables with as many buckets of the same key join without a
    shuffle."""
    if bool(bucket_by) != bool(buckets):
        raise ValueError("buckets need both columns and a number")
    columns = ", ".join(_column_clause(c) for c in contract.columns)
    text = f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {fmt}"
    generated = [(i, c) for i, c in enumerate(contract.columns) if _filled_at_load(c)]
    if generated:
        text += " TBLPROPERTIES ({})".format(", ".join(
            f"'{GENERATED}{i}' = '{_sql(c)}'" for i, c in generated))
    if contract.partition_by:
        text += " PARTITIONED BY ({})".format(", ".join(quoted(c) for c in contract.partition_by))
    if bucket_by:
        text += " CLUSTERED BY ({})".format(", ".join(quoted(c) for c in bucket_by))
        if contract.order_by:
            text += " SORTED BY ({})".format(", ".join(quoted(c) for c in contract.order_by))
        text += f" INTO {buckets} BUCKETS"
    if contract.description:
        text += " COMMENT '{}'".format(
            contract.description.replace("\\", "\\\\").replace("'", "\\'"))
    return text


def create_table(spark: SparkSession, contract: Contract, fmt: str = "parquet",
                 namespace: str | None = None, bucket_by: tuple[str, ...] = (),
                 buckets: int = 0) -> CatalogTable:
    """Catalog table for a contract, if absent; an existing table is left alone."""
    schema = namespace or contract.target_schema()
    name = f"{quoted(schema)}.{quoted(contract.table)}"
    spark.sql(create_statement(contract, name, fmt, bucket_by, buckets))
    return CatalogTable(spark, name)


def create_all(spark: SparkSession, contracts: list[Contract], fmt: str = "parquet",
               default: str | None = None) -> list[str]:
    """Namespaces and tables for every contract that has columns; errors come back as text."""
    contracts = [c for c in contracts if c.columns]
    errors = []
    for name in namespaces_of(contracts, default):
        create_namespace(spark, name)
    for contract in contracts:
        try:
            create_table(spark, contract, fmt, contract.target_schema(default))
        except Exception as problem:  # report all tables, as a user fixes contracts in one go
            errors.append(f"{contract.table}: {str(problem).splitlines()[0]}")
    return errors


def ensure_target(spark: SparkSession, target: Table, contract: Contract) -> bool:
    """Create a folder or database table from the contract if absent. True if created."""
    if isinstance(target, PathTable):
        return target.create()
    if isinstance(target, JdbcTable):
        if target.exists():
            return False
        target.column_types = ", ".join(
            f"{quoted(c.name)} {table_type(c.type)}" for c in contract.columns
            if table_type(c.type) != c.spark_type.simpleString()) or None
        target.create_options = target.connection.create_options(
            contract.primary_key, contract.engine, contract.order_by, contract.partition_by)
        target.append(spark.createDataFrame([], contract.to_struct()))
        return True
    raise TypeError(f"cannot create {type(target).__name__}; use create_table")
