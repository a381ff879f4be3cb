"""Contracts of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulframe import Contract, PathTable

# Column types, keys, references and marks of the given tables.
_TABLES = {
    "region": "r_regionkey integer pk; r_name text",
    "nation": "n_nationkey integer pk; n_name text; n_regionkey integer > region(r_regionkey)",
    "customer": "c_custkey bigint pk; c_name text; c_nationkey integer > nation(n_nationkey); "
                "c_acctbal double; c_mktsegment text",
    "supplier": "s_suppkey bigint pk; s_name text; s_nationkey integer > nation(n_nationkey); "
                "s_acctbal double",
    "part": "p_partkey bigint pk; p_name text; p_brand text; p_type text; p_size integer; "
            "p_retailprice double",
    "orders": "o_orderkey bigint pk; o_custkey bigint > customer(c_custkey); o_orderstatus text; "
              "o_totalprice double; o_orderdate timestamp; o_orderpriority text",
    "lineitem": "l_orderkey bigint > orders(o_orderkey); l_partkey bigint > part(p_partkey); "
                "l_suppkey bigint > supplier(s_suppkey); l_linenumber integer; "
                "l_quantity double; l_extendedprice double; l_discount double; l_tax double; "
                "l_returnflag text; l_linestatus text; l_shipdate timestamp",
    "events": "event_id bigint pk; ts timestamp; user_id bigint; event_type text; value double; "
              "props text",
    "documents": "doc_id bigint pk; text text; lang text; source text; n_chars bigint",
    "labels": "doc_id bigint > documents(doc_id); quality integer; toxic integer",
    "embeddings": "vec_id bigint pk; embedding array<float>; label integer",
    "pages": "page_id bigint pk; url text; html text",
    "benchmark": "item_id bigint pk; text text",
    "conversations": "conv_id bigint pk; turn bigint pk; role text; text text",
}
TABLES = list(_TABLES)


def _column(text: str) -> dict:
    declared, _, reference = text.partition(" > ")
    name, kind, *flags = declared.split()
    return {"name": name, "type": kind, "primary_key": "pk" in flags,
            "nullable": "pk" not in flags, "foreign_key": reference or None}


def contract(table: str, **changes) -> Contract:
    """Contract of a given table; ``changes`` override contract keys, such as its schedule."""
    columns = [_column(c.strip()) for c in _TABLES[table].split(";")]
    return Contract.from_dict({"table": table, "columns": columns, **changes})


def contracts() -> list[Contract]:
    return [contract(t) for t in TABLES]


def given(spark: SparkSession, sf_dir: str, table: str) -> PathTable:
    return PathTable(spark, f"{sf_dir}/{table}.parquet")


def frame(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return given(spark, sf_dir, table).read()
