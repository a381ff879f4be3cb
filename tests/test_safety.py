"""Loads that fail, keys and marks that do not match, and databases that refuse."""

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

import haulframe as hf
from haulframe.contract import ColumnSpec, merge_described
from haulframe.operators import references
from haulframe.operators.conform import conform, conform_report
from haulframe.plans.load import in_mark_order
from haulframe.sources import storage
from haulframe.sources.connection import SYSTEM_SCHEMAS, Connection
from haulframe.sources.metadata import facts_of, with_facts
from haulframe.sources.tables import hash_column, open_table, range_column


def contract(table, columns, schema=None, **load):
    return hf.Contract.from_dict({"table": table, "schema": schema, "schedule": load,
                                  "columns": columns})


def test_failing_full_load_leaves_a_catalog_table(spark):
    spark.sql("DROP TABLE IF EXISTS safe_full")
    spark.range(10).write.saveAsTable("safe_full")
    target = hf.CatalogTable(spark, "safe_full")
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no")).cast("long"))
                                .otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        hf.load_table(bad, target)
    assert target.read().count() == 10
    assert hf.load_table(spark.range(3), target).rows == 3
    assert target.read().count() == 3


def test_uuid_defaults_are_filled_in_catalog_tables(spark):
    spark.sql("DROP TABLE IF EXISTS uuid_target")
    hf.create_table(spark, contract("uuid_target", [
        {"name": "id", "type": "bigint"},
        {"name": "token", "type": "uuid", "nullable": False, "default": "gen_random_uuid()"}]),
        namespace="default")
    hf.CatalogTable(spark, "default.uuid_target").append(spark.range(5))
    rows = spark.table("default.uuid_target").collect()
    assert len({r.token for r in rows}) == 5 and all(len(r.token) == 36 for r in rows)


def test_tables_of_one_name_in_two_schemas(spark, tmp_path):
    specs = [{"name": "id", "type": "bigint"}]
    a, b = (contract("orders", specs, s) for s in "ab")
    child = contract("lines", [{"name": "order_id", "type": "bigint",
                                "foreign_key": "b.orders(id)"}], "b")
    assert hf.in_parent_order([child, a, b]) == [a, b, child]
    broken = spark.range(1).select(F.raise_error(F.lit("broken source")).cast("long").alias("id"))
    sources = {a.key: broken, b.key: spark.range(4),
               child.key: spark.range(2).select(F.col("id").alias("order_id"))}
    with pytest.raises(hf.LoadError) as failed:
        hf.load_all(spark, [child, a, b], lambda c: sources[c.key],
                    lambda c: hf.PathTable(spark, f"{tmp_path}/{c.schema}/{c.table}"))
    assert list(failed.value.errors) == ["a.orders"]
    assert [(r.table, r.rows) for r in failed.value.results] == [("b.orders", 4), ("lines", 2)]


def test_describing_again_keeps_keys():
    given = contract("t", [
        {"name": "id", "type": "int", "primary_key": True, "nullable": False},
        {"name": "p", "type": "int", "foreign_key": "parents(id)", "default": 1},
        {"name": "gone", "type": "int"}])
    fresh = hf.Contract("t", (ColumnSpec("id", "bigint"), ColumnSpec("p", "bigint"),
                              ColumnSpec("new", "text")))
    merged = merge_described(given, fresh)
    assert [c.name for c in merged.columns] == ["id", "p", "new"]
    assert merged.primary_key == ["id"] and merged.columns[0].type == "bigint"
    assert str(merged.column("p").foreign_key) == "parents(id)" and merged.column("p").default == 1


def test_unlike_marks_are_refused(spark, tmp_path):
    target = hf.PathTable(spark, str(tmp_path / "t"))
    target.append(spark.range(12).select(F.col("id").cast("string").alias("id")))
    spec = hf.LoadSpec("incremental", "id")
    with pytest.raises(ValueError, match="bigint in the source and string in the target"):
        hf.load_table(spark.range(15), target, spec=spec)
    assert target.read().count() == 12


def test_missed_rows_know_null_keys_and_the_mark(spark):
    rows = "SELECT * FROM VALUES {} AS t(id, at)"
    target = spark.sql(rows.format("(1, 5), (CAST(NULL AS INT), 4), (2, 9)"))
    source = spark.sql(rows.format(
        "(1, 5), (CAST(NULL AS INT), 4), (2, 9), (3, 9), (4, 10), (5, CAST(NULL AS INT)), (6, 1)"))
    got = hf.missed_rows(source, target, ["id"], "at").collect()
    assert sorted(r.id for r in got) == [3, 5, 6]
    assert sorted(r.id for r in hf.missed_rows(source, target, ["id"]).collect()) == [3, 4, 5, 6]


def test_fractions_are_not_dropped_silently(spark):
    small = contract("t", [{"name": "n", "type": "smallint"}, {"name": "d", "type": "numeric(5,1)"}])
    df = spark.sql("SELECT * FROM VALUES (12.7D, 1.25), (12D, 1.50), (NULL, NULL) AS t(n, d)")
    assert [r.failures for r in conform_report(df, small).orderBy("column").collect()] == [1, 1]
    with pytest.raises(Exception, match="no smallint for value 12.7"):
        conform(df.select("n", F.lit(1).cast("decimal(5,1)").alias("d")), small).collect()
    assert conform(df.where("n = 12"), small).first().n == 12


def test_null_child_keys_stay_out_of_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    child = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
    parent = spark.range(0, 1000, 10)
    valid = references.fk_valid_rows(child, "k", parent, "id")
    assert valid.count() == 1900 and valid.where("k IS NULL").count() == 1800
    assert references.fk_invalid_rows(child, "k", parent, "id").count() == 100


def test_files_of_a_delta_do_not_overlap(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).select(F.pmod(F.hash("id"), F.lit(5000)).alias("m"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        in_mark_order(rows, "m").write.parquet(str(tmp_path / "d"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = (spark.read.parquet(str(tmp_path / "d")).groupBy(F.input_file_name())
             .agg(F.min("m").alias("low"), F.max("m").alias("high")).orderBy("low").collect())
    assert len(spans) > 4
    assert all(a.high <= b.low for a, b in zip(spans, spans[1:]))


def test_streams_honour_the_options(spark, tmp_path):
    strict = contract("t", [{"name": "id", "type": "bigint", "nullable": False},
                            {"name": "v", "type": "varchar(3)"}])
    target = hf.PathTable(spark, str(tmp_path / "t"), contract=strict)
    spark.sql("SELECT 1 AS id, 'abc' AS v").write.parquet(str(tmp_path / "in"))
    options = hf.LoadOptions(conform=True, enforce=True)

    def run():
        schema = "id int, v string"
        hf.run_arrivals(hf.read_arrivals(spark, str(tmp_path / "in"), T._parse_datatype_string(
            schema)), target, str(tmp_path / "ck"), options)

    run()
    assert target.read().count() == 1
    spark.sql("SELECT 2 AS id, 'too long' AS v").write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="length"):
        run()
    assert target.read().count() == 1


class Stub(hf.JdbcTable):
    """A database table without a database."""

    def __init__(self, spark, layout, refuses=False, **options):
        super().__init__(spark, Connection("postgresql", host="h", database="d"), "t", **options)
        self.layout, self.refuses, self.done = layout, refuses, []

    def exists(self):
        return True

    def columns(self):
        return T._parse_datatype_string(self.layout)

    def _writer(self, df, mode):
        table = self

        class Writer:
            def option(self, *_):
                return self

            def save(self):
                if mode == "overwrite" and table.refuses:
                    raise PySparkException("cannot truncate a table referenced in a foreign key")
                table.done.append((mode, df.columns, df.collect()))

        return Writer()

    def _execute(self, statement):
        self.done.append(statement)


def test_databases_get_the_sources_columns_only(spark):
    table = Stub(spark, "id bigint, made timestamp, note string")
    table.append(spark.sql("SELECT 'x' AS NOTE, 1 AS id"))
    mode, columns, rows = table.done[0]
    assert (mode, columns) == ("append", ["id", "note"]) and rows[0].note == "x"
    with pytest.raises(ValueError, match="extra"):
        table.append(spark.sql("SELECT 1 AS id, 2 AS extra"))


def test_refused_truncate_becomes_delete(spark):
    table = Stub(spark, "id bigint", refuses=True)
    table.replace(spark.range(2))
    assert table.done[0] == 'DELETE FROM "public"."t"'
    assert [r.id for r in table.done[1][2]] == [0, 1]
    kind = Stub(spark, "id bigint")
    kind.replace(spark.range(2))
    assert [d[0] for d in kind.done] == ["overwrite", "append"]


def test_write_tasks_can_be_left_open(spark):
    wide = spark.range(0, 100, 1, 40)
    assert Stub(spark, "id bigint", write_tasks=None)._laid_out(wide).rdd.getNumPartitions() == 40
    assert Stub(spark, "id bigint", write_tasks=4)._laid_out(wide).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("kind", ["postgresql", "mysql", "sqlserver", "clickhouse", "duckdb"])
def test_bucket_predicates(kind):
    found = Connection(kind, host="h", database="d").bucket_predicates("key", 5)
    assert len(found) == 5
    assert all("IS NULL THEN 0" in p and p.endswith(f"% 5 END) = {i}")
               for i, p in enumerate(found))
    assert Connection("derby", database="d").bucket_predicates("key", 5) is None


def test_buckets_hold_each_row_once():
    duck = duckdb.connect()
    duck.execute("CREATE TABLE t AS SELECT CASE WHEN i % 7 > 0 THEN 'k' || i END AS key "
                 "FROM range(1000) AS r(i)")
    predicates = Connection("duckdb", host=":memory:").bucket_predicates("key", 6)
    counts = [duck.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in predicates]
    assert sum(counts) == 1000 and min(counts) > 50


def test_split_columns(spark):
    def keyed(kind, mark=None):
        return contract("t", [{"name": "k", "type": kind, "primary_key": True},
                              {"name": "m", "type": mark or "text"}],
                        mode="incremental", incremental_column="m")

    assert range_column(keyed("bigint")) == "k"
    assert range_column(keyed("uuid", "double precision")) is None
    assert hash_column(keyed("uuid", "double precision")) == "k"
    table = open_table(spark, Connection("postgresql", host="h", database="d"), "t",
                       keyed("uuid"), source=True)
    assert table.hashed and table.partition_column == "k"


def test_layout_expressions_and_catalog_names(spark):
    click = Connection("clickhouse", host="h", database="d")
    text = click.create_options(["id"], None, (), ("toYYYYMM(ts)", "region"))
    quoted = click.quoted("region")
    assert f"PARTITION BY (toYYYYMM(ts), {quoted})" in text
    assert hf.Contract.from_dict({"table": "t", "partition_by": "(f(a, b), c)"}).partition_by == (
        "f(a, b)", "c")
    names = {Connection("postgresql", host="h", database=d).catalog(spark)
             for d in ("db-1", "db.1", "db_1")}
    assert len(names) == 3


def test_nested_values_are_measured(spark):
    nested = spark.range(10).select(F.array_repeat(F.lit(123456789), 1000).alias("a"),
                                    F.map_from_arrays(F.array(F.lit("k")), F.array("id")).alias("m"))
    assert storage.stage(nested, "nested").bytes > 10 * 8000


def test_metadata_rows_become_keys(spark):
    facts = facts_of({
        "keys": [{"COLUMN_NAME": "id"}],
        "references": [
            {"FKCOLUMN_NAME": "p", "PKTABLE_SCHEM": "public", "PKTABLE_NAME": "parents",
             "PKCOLUMN_NAME": "id", "FK_NAME": "f1"},
            {"FKCOLUMN_NAME": "q", "PKTABLE_SCHEM": "other", "PKTABLE_NAME": "far",
             "PKCOLUMN_NAME": "k", "FK_NAME": None},
            {"FKCOLUMN_NAME": "a", "PKTABLE_SCHEM": "public", "PKTABLE_NAME": "two",
             "PKCOLUMN_NAME": "a", "FK_NAME": "f2"},
            {"FKCOLUMN_NAME": "b", "PKTABLE_SCHEM": "public", "PKTABLE_NAME": "two",
             "PKCOLUMN_NAME": "b", "FK_NAME": "f2"}],
        "indexes": [
            {"INDEX_NAME": "pk", "COLUMN_NAME": "id", "NON_UNIQUE": "false"},
            {"INDEX_NAME": "u", "COLUMN_NAME": "mail", "NON_UNIQUE": "false"},
            {"INDEX_NAME": "n", "COLUMN_NAME": "p", "NON_UNIQUE": "true"},
            {"INDEX_NAME": "m", "COLUMN_NAME": "a", "NON_UNIQUE": "0"},
            {"INDEX_NAME": "m", "COLUMN_NAME": "b", "NON_UNIQUE": "0"},
            {"INDEX_NAME": "s", "COLUMN_NAME": None, "NON_UNIQUE": "0"}],
        "columns": [
            {"COLUMN_NAME": "id", "COLUMN_DEF": None, "NULLABLE": "0"},
            {"COLUMN_NAME": "mail", "COLUMN_DEF": "'x'::text", "NULLABLE": "0"},
            {"COLUMN_NAME": "p", "COLUMN_DEF": None, "NULLABLE": "1"}],
    }, "postgresql", "public")
    id_, mail, p = with_facts((ColumnSpec("id", "bigint"), ColumnSpec("mail", "text"),
                               ColumnSpec("p", "bigint")), facts)
    assert id_.primary_key and not id_.unique and not id_.nullable
    assert mail.unique and not mail.nullable and mail.default == "x"
    assert str(p.foreign_key) == "parents(id)" and p.nullable
    assert str(facts.references["q"]) == "other.far(k)"
    assert set(facts.references) == {"p", "q"}


def test_system_schemas_are_those_of_the_database():
    assert "system" in SYSTEM_SCHEMAS["clickhouse"]
    assert "system" not in SYSTEM_SCHEMAS["postgresql"] and "mysql" not in SYSTEM_SCHEMAS["derby"]


def test_described_tables_join_the_manifest(spark, tmp_path):
    (tmp_path / "project" / "schemas").mkdir(parents=True)
    project = tmp_path / "project"
    (project / ".env").write_text(
        f"DB_ORIGEM_TYPE=parquet\nDB_ORIGEM_HOST={tmp_path}/lake\n"
        f"DB_DESTINO_TYPE=parquet\nDB_DESTINO_HOST={tmp_path}/out\n")
    (project / "main.yml").write_text("name: shop\ntables: []\n")
    spark.range(3).write.parquet(f"{tmp_path}/lake/fresh")
    opened = hf.Project.open(spark, project)
    assert opened.describe("fresh") == ["fresh"]
    again = hf.Project.open(spark, project)
    assert [c.table for c in again.contracts] == ["fresh"]
    assert "name: shop" in (project / "main.yml").read_text()
