"""Folders, databases and catalog tables as load ends."""

import uuid

import pytest
from pyspark.sql import functions as F

import haulframe as hf
from haulframe.sources.listing import describe_missing
from haulframe.sources.tables import range_column
from haulframe.sources.storage import Storage, scratch_path, shared_dir, stage

ORDERS = "/root/testdata/sf0.001/orders.parquet"


def incremental(column):
    return hf.LoadSpec("incremental", column)


# -- connections -------------------------------------------------------------------------


@pytest.mark.parametrize("host, database, expected", [
    ("s3://bucket/lake/", "", "s3a://bucket/lake"),
    ("http://minio:9000", "lake", "s3a://lake"),
    ("https://minio:9000", "", "s3a://deltalake"),
    ("/data", "lake", "/data/lake"),
    ("/data/lake", "lake", "/data/lake"),
    ("/data/", ".", "/data"),
    ("/data", "", "/data"),
])
def test_warehouse_paths(host, database, expected):
    assert hf.Connection("deltalake", host, database=database).warehouse == expected


def test_warehouse_needs_a_host():
    with pytest.raises(ValueError, match="host"):
        hf.Connection("deltalake", " ").warehouse


def test_storage_options():
    options = hf.Connection("deltalake", "http://minio:9000", user="u", password="p",
                            database="b").storage_options()
    assert options["spark.hadoop.fs.s3a.endpoint"] == "http://minio:9000"
    assert options["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert hf.Connection("deltalake", "/data").storage_options() == {}


@pytest.mark.parametrize("kind, url, qualified", [
    ("postgresql", "jdbc:postgresql://h:5432/db", '"public"."t"'),
    ("mysql", "jdbc:mysql://h:3306/db", "`db`.`t`"),
    ("sqlserver", "jdbc:sqlserver://h:1433;databaseName=db;encrypt=true;"
                  "trustServerCertificate=true", "[dbo].[t]"),
    ("clickhouse", "jdbc:clickhouse://h:8123/db", "`db`.`t`"),
    ("duckdb", "jdbc:duckdb:h", '"main"."t"'),
])
def test_database_addresses(kind, url, qualified):
    connection = hf.Connection(kind, "h", database="db", user="u", password="secret")
    assert connection.url == url and connection.qualified("t") == qualified
    options = connection.jdbc_options()
    assert options["fetchsize"] == options["batchsize"] == "20000"
    assert "secret" not in repr(connection)


def test_database_layouts():
    house = hf.Connection("clickhouse", "h")
    assert house.create_options(["id"]) == "ENGINE = MergeTree ORDER BY (`id`)"
    assert house.create_options([], "Log", (), ("day",)) == (
        "ENGINE = Log PARTITION BY (`day`) ORDER BY tuple()")
    assert house.create_options(["id"], order_by=("ts", "id")).endswith("ORDER BY (`ts`, `id`)")
    assert hf.Connection("postgresql", "h").create_options(["id"]) is None
    assert hf.Connection("postgresql", "h").jdbc_options()["stringtype"] == "unspecified"


def test_identifier_quoting():
    assert hf.Connection("postgresql", "h").quoted('a"b') == '"a""b"'
    assert hf.Connection("mysql", "h").quoted("a`b") == "`a``b`"
    assert hf.Connection("sqlserver", "h").quoted("a]b") == "[a]]b]"


def test_connection_from_env():
    values = {"X_TYPE": "postgresql", "X_HOST": "db", "X_USER": "me", "X_PASSWORD": "pw",
              "X_STATEMENT_TIMEOUT": "0"}
    connection = hf.Connection.from_env(values, "X")
    assert (connection.port, connection.database, connection.default_schema) == (
        "5432", "postgres", "public")
    assert connection.jdbc_options()["options"] == "-c statement_timeout=0"
    with pytest.raises(ValueError, match="X_TYPE"):
        hf.Connection.from_env({"X_TYPE": "oracle"}, "X")


# -- shared storage ----------------------------------------------------------------------


def test_scratch_is_in_the_folder_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_settings_grow_with_the_shuffle():
    small, large = hf.sized_settings(1, 8), hf.sized_settings(16 * 1024**4, 1000)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert large["spark.sql.shuffle.partitions"] == str(131072)


def test_stage_measures_what_it_writes(spark):
    staged = stage(spark.sql("SELECT 'abcd' AS s, 1 AS n UNION ALL SELECT NULL, 2"), "t")
    assert (staged.rows, staged.bytes) == (2, 2 * (16 + 16 + 16) + 4)
    assert staged.df.count() == 2 and staged.broadcastable


# -- folders -----------------------------------------------------------------------------


def test_partitioned_folder_needs_types(spark, folder):
    with pytest.raises(ValueError, match="contract or a schema"):
        hf.PathTable(spark, folder, partition_by=("day",))


def test_layout_takes_columns_not_expressions(spark, folder):
    declared = hf.Contract.from_dict({"table": "t", "partition_by": "toYYYYMM(at)", "columns": [
        {"name": "at", "type": "timestamp"}]})
    with pytest.raises(ValueError, match="toYYYYMM"):
        hf.PathTable(spark, folder, contract=declared)


def test_partitioned_folder(spark, folder):
    declared = hf.Contract.from_dict({
        "table": "t", "partition_by": "day", "order_by": ["id"], "columns": [
            {"name": "day", "type": "text"}, {"name": "id", "type": "bigint"}]})
    target = hf.PathTable(spark, folder, contract=declared)
    # One day holds most rows; days look like dates but are text.
    days = F.when(F.col("id") < 80, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02"))
    assert target.append(spark.range(100).select("id", days.alias("day"))).rows == 100
    assert target.read().columns == ["day", "id"]
    assert target.read().schema["day"].dataType.simpleString() == "string"
    assert target.read().where("day = '2024-01-01'").count() == 80
    names = Storage(spark, folder).list(folder)
    assert {n for n in names if "=" in n} == {"day=2024-01-01", "day=2024-01-02"}
    target.truncate()
    assert target.exists() and target.read().count() == 0
    target.append(spark.range(3).select("id", F.lit("x").alias("day")))
    assert target.read().count() == 3


def test_rebalance_hint_is_in_the_plan(spark, folder):
    target = hf.PathTable(spark, folder, schema=spark.read.parquet(ORDERS).schema,
                          partition_by=("o_orderstatus",), sort_by=("o_orderdate",))
    plan = target._laid_out(spark.read.parquet(ORDERS))._jdf.queryExecution().executedPlan()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan.toString()


def test_create_leaves_an_existing_folder_alone(spark, folder):
    declared = hf.Contract.from_dict({"table": "t", "columns": [
        {"name": "id", "type": "bigint", "primary_key": True},
        {"name": "v", "type": "varchar(3)", "default": "new"}]})
    target = hf.PathTable(spark, folder, contract=declared)
    assert target.create() and target.read().count() == 0
    target.append(spark.range(2))
    assert not target.create()
    assert [r.v for r in target.read().collect()] == ["new", "new"]


def test_truncate_keeps_columns(spark, folder):
    target = hf.PathTable(spark, folder)
    target.append(spark.read.parquet(ORDERS))
    before = target.columns()
    target.truncate()
    assert target.columns() == before and target.read().count() == 0


def test_other_file_formats(spark, tmp_path):
    for fmt in ("orc", "json"):
        target = hf.PathTable(spark, str(tmp_path / fmt), fmt,
                              schema=spark.read.parquet(ORDERS).schema)
        hf.load_table(hf.PathTable(spark, ORDERS), target, spec=incremental("o_orderdate"))
        assert target.read().count() == 1500
        assert hf.load_table(hf.PathTable(spark, ORDERS), target,
                             spec=incremental("o_orderdate")).rows == 0


def test_lake_listing(spark, tmp_path):
    lake = hf.Connection("parquet", str(tmp_path))
    for name in ("b", "a"):
        hf.open_table(spark, lake, name).append(spark.range(1))
    (tmp_path / "_hidden").mkdir()
    assert [tuple(r) for r in hf.list_tables(spark, lake).collect()] == [
        (tmp_path.name, "a"), (tmp_path.name, "b")]
    delta = hf.Connection("deltalake", str(tmp_path))
    assert hf.list_tables(spark, delta).count() == 0
    (tmp_path / "d" / "_delta_log").mkdir(parents=True)
    assert [r.table for r in hf.list_tables(spark, delta).collect()] == ["d"]
    assert hf.list_tables(spark, hf.Connection("parquet", "/no/such")).count() == 0


# -- databases: an in-memory one inside this process, no server and no port ----------------


@pytest.fixture
def database():
    return hf.Connection("derby", database=f"memory:t{uuid.uuid4().hex}")


def test_database_roundtrip(spark, database, folder):
    orders = hf.PathTable(spark, ORDERS)
    table = hf.JdbcTable(spark, database, "orders")
    assert not table.exists()
    early = orders.read().where("o_orderdate <= timestamp_ntz'1999-01-01 00:00:00'")
    options = hf.LoadOptions(enforce=False)
    assert table.append(early).rows == early.count()
    assert table.exists()
    result = hf.load_table(orders, table, spec=incremental("o_orderdate"), options=options)
    assert result.rows == 1500 - early.count()
    assert table.high_water_mark("o_orderdate") == result.watermark
    back = hf.PathTable(spark, folder)
    hf.load_table(table, back, spec=hf.LoadSpec("full"))
    assert back.read().exceptAll(orders.read()).count() == 0
    assert back.read().count() == 1500


def test_database_pushdown(spark, database):
    table = hf.JdbcTable(spark, database, "orders")
    table.append(spark.read.parquet(ORDERS))
    plan = table.read_above("o_orderdate", "2000-01-01 00:00:00")
    assert "*GreaterThan(o_orderdate" in plan._jdf.queryExecution().executedPlan().toString()
    top = spark.table(table._in_catalog).agg(F.max("o_orderdate"))
    assert "PushedAggregates: [MAX" in top._jdf.queryExecution().executedPlan().toString()


def test_database_parallel_read(spark, database):
    hf.JdbcTable(spark, database, "orders").append(spark.read.parquet(ORDERS))
    contract = hf.Contract.from_dict({"table": "orders", "columns": [
        {"name": "o_orderkey", "type": "bigint", "primary_key": True}]})
    table = hf.open_table(spark, database, "orders", contract, source=True, partitions=4)
    assert table.read().rdd.getNumPartitions() == 4
    late = table.read_above("o_orderdate", "2000-01-01 00:00:00")
    assert late.rdd.getNumPartitions() == 4
    assert late.count() == spark.read.parquet(ORDERS).where(
        "o_orderdate > timestamp_ntz'2000-01-01 00:00:00'").count()


def test_database_read_in_day_ranges(spark, database):
    days = spark.sql("SELECT id, date_add(DATE'2024-01-01', int(id)) AS day FROM range(40)"
                     " UNION ALL SELECT 40, NULL")
    hf.JdbcTable(spark, database, "t").append(days)
    contract = hf.contract_of("t", days.schema)
    table = hf.open_table(spark, database, "t", contract, source=True, partitions=5)
    assert table.partition_column == "day"
    assert table.read().rdd.getNumPartitions() == 5
    assert sorted(r.id for r in table.read().collect()) == list(range(41))
    late = table.read_above("day", "2024-01-11")
    assert late.count() == 29


def test_range_column():
    def of(*columns, **schedule):
        return range_column(hf.Contract.from_dict({
            "table": "t", "schedule": schedule, "columns": list(columns)}))

    key = {"name": "id", "type": "bigint", "primary_key": True}
    text = {"name": "code", "type": "text", "primary_key": True}
    day = {"name": "day", "type": "date"}
    assert of(key, day) == "id"
    assert of(text, key) == "id"
    assert of(text) is None
    assert of(text, {"name": "at", "type": "timestamp"}, mode="incremental",
              incremental_column="at") is None
    assert of(text, day, mode="incremental", incremental_column="day") == "day"
    assert of(text, mode="incremental", incremental_column="code") is None


def test_database_writes_open_few_connections(spark, database):
    table = hf.JdbcTable(spark, database, "t", write_tasks=2)
    assert table.append(spark.range(0, 100, 1, 50)).rows == 100
    assert table.read().count() == 100


def test_database_full_load_keeps_column_types(spark, database):
    declared = hf.Contract.from_dict({"table": "people", "columns": [
        {"name": "id", "type": "integer", "primary_key": True},
        {"name": "name", "type": "varchar(7)"}]})
    table = hf.open_table(spark, database, "people", declared)
    table = hf.JdbcTable(spark, database, "people")
    assert hf.ensure_target(spark, table, declared)
    assert not hf.ensure_target(spark, table, declared)
    rows = spark.sql("SELECT 1 AS id, 'ab' AS name")
    for _ in range(2):
        hf.load_table(rows, table, declared, options=hf.LoadOptions(enforce=True))
    assert [tuple(r) for r in table.read().collect()] == [(1, "ab")]
    assert hf.describe("people", table).column("name").type == "varchar(7)"
    with pytest.raises(Exception):
        table.append(spark.sql("SELECT 2 AS id, 'much too long' AS name"))
    table.truncate()
    assert table.read().count() == 0


def test_database_enforces_by_default(spark, database):
    declared = hf.Contract.from_dict({"table": "t", "columns": [
        {"name": "id", "type": "integer", "primary_key": True}]})
    table = hf.JdbcTable(spark, database, "t")
    with pytest.raises(hf.ConstraintError):
        hf.load_table(spark.sql("SELECT 1 AS id UNION ALL SELECT 1"), table, declared)
    assert not table.exists()


def test_database_verifies_counts(spark, database, monkeypatch):
    table = hf.JdbcTable(spark, database, "t", verify=True)
    table.append(spark.range(5))
    assert hf.load_table(spark.range(5, 9), table, spec=incremental("id")).rows == 4
    send = table._append
    monkeypatch.setattr(table, "_append", lambda df: (send(df), send(df.limit(1))))
    with pytest.raises(RuntimeError, match="written twice"):
        table.append(spark.range(10, 12))


def test_enforced_load_from_a_database_reads_it_once(spark, database, folder, monkeypatch):
    declared = hf.Contract.from_dict({"table": "t", "columns": [
        {"name": "id", "type": "bigint", "primary_key": True},
        {"name": "up", "type": "bigint", "unique": True}]})
    source = hf.JdbcTable(spark, database, "t")
    source.append(spark.sql("SELECT id, id AS up FROM range(4)"))
    target = hf.PathTable(spark, folder)
    seen = []
    write = target._append
    monkeypatch.setattr(target, "_append", lambda df: (
        seen.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df)))
    target.append(source.read().where("id > 2"))
    target.truncate()
    result = hf.load_table(source, target, declared, incremental("id"),
                           hf.LoadOptions(enforce=True))
    assert result.rows == 4
    assert "JDBCRelation" in seen[0] and "JDBCRelation" not in seen[1]


def test_database_listing_and_description(spark, database):
    hf.JdbcTable(spark, database, "orders").append(spark.read.parquet(ORDERS))
    hf.JdbcTable(spark, database, "a b").append(spark.sql("SELECT 1 AS `x y`"))
    assert [tuple(r) for r in hf.list_tables(spark, database).collect()] == [
        ("APP", "a b"), ("APP", "orders")]
    given = [hf.Contract("orders", description="mine"), hf.Contract("gone"),
             hf.Contract("kept", (hf.ColumnSpec("id", "integer"),))]
    with pytest.warns(UserWarning, match="gone"):
        orders, gone, kept = describe_missing(spark, database, given)
    assert orders.description == "mine" and not gone.columns and kept == given[2]
    assert [(c.name, c.type) for c in orders.columns][:2] == [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint")]
    assert orders.column("o_orderdate").type == "timestamp"


def test_nested_values_reach_a_database_as_json(spark, database):
    table = hf.JdbcTable(spark, database, "t")
    hf.load_table(spark.sql("SELECT 1 AS id, ARRAY(1, 2) AS l"), table)
    assert table.read().first().l == "[1,2]"


# -- the session catalog -----------------------------------------------------------------


@pytest.fixture
def namespace(spark, tmp_path):
    name = f"ns_{uuid.uuid4().hex}"
    hf.create_namespace(spark, name, str(tmp_path / name))
    yield name
    spark.sql(f"DROP NAMESPACE {name} CASCADE")


def test_catalog_table_from_contract(spark, namespace):
    declared = hf.Contract.from_dict({
        "table": "t", "schema": namespace, "description": "it's", "partition_by": "day",
        "columns": [
            {"name": "id", "type": "integer", "primary_key": True},
            {"name": "code", "type": "varchar(3)", "default": "new"},
            {"name": "made", "type": "timestamp", "default": "CURRENT_TIMESTAMP"},
            {"name": "key", "type": "uuid", "default": "gen_random_uuid()"},
            {"name": "day", "type": "text"}]})
    target = hf.create_table(spark, declared)
    hf.create_table(spark, declared)
    assert target.append(spark.sql("SELECT 'd' AS day, 1 AS id")).rows == 1
    row = target.read().first()
    assert (row.id, row.code, row.day) == (1, "new", "d") and row.made and len(row.key) == 36
    with pytest.raises(Exception, match="EXCEED"):
        target.append(spark.sql("SELECT 'd' AS day, 1 AS id, 'long' AS code"))
    full = hf.load_table(spark.sql("SELECT 'e' AS day, 2 AS id"), target,
                         spec=hf.LoadSpec("full"))
    assert full.rows == 1
    assert [(r.id, r.day) for r in target.read().collect()] == [(2, "e")]
    target.truncate()
    assert target.read().count() == 0
    assert [tuple(r) for r in hf.list_catalog_tables(spark, namespace).collect()] == [
        (namespace, "t")]


def test_create_all_reports_errors(spark, namespace):
    contracts = [
        hf.Contract.from_dict({"table": "ok", "schema": namespace,
                               "columns": [{"name": "id", "type": "integer"}]}),
        hf.Contract.from_dict({"table": "bad", "schema": namespace,
                               "columns": [{"name": "id", "type": "integr"}]}),
        hf.Contract.from_dict({"table": "empty", "schema": namespace}),
    ]
    errors = hf.create_all(spark, contracts)
    assert len(errors) == 1 and errors[0].startswith("bad:")
    assert spark.catalog.tableExists(f"{namespace}.ok")


def test_summary(spark):
    declared = hf.Contract.from_dict({"table": "t", "columns": [
        {"name": "id", "type": "integer", "primary_key": True},
        {"name": "up", "type": "integer", "foreign_key": "t(id)"},
        {"name": "code", "type": "text", "unique": True}]})
    row = hf.contract_summary(spark, [declared], {"t": spark.range(4)}).first()
    assert row.asDict() == {"table": "t", "schema": "public", "columns": 3, "primary_keys": 1,
                            "foreign_keys": 1, "uniques": 1, "required": 1, "rows": 4}
    assert hf.contract_summary(spark, [declared]).count() == 1
