import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import haulframe as hf
from haulframe.sources.curve import along_curve, interleaved


def spans(table, *columns):
    rows = table.read().groupBy(F.col("_metadata.file_path").alias("file"))
    return rows.agg(*[f(c) for c in columns for f in (F.min, F.max)]).collect()


def test_files_are_narrow_in_every_column(spark, folder):
    rows = spark.range(20_000).select(
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"),
        F.hex(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1000))).alias("b"), "id")
    table = hf.PathTable(spark, folder, cluster_by=("a", "b"), cluster_files=16)
    table.append(rows)
    files = spans(table, "a", "b")
    assert len(files) == 16
    low = rows.agg(F.min("b")).first()[0]
    assert sum(r[1] <= 100 <= r[2] for r in files) <= 8
    assert sum(r[3] <= low <= r[4] for r in files) <= 8
    assert sorted(r.id for r in table.read().collect()) == list(range(20_000))


def test_interleaving(spark):
    got = spark.range(1).select(interleaved([F.lit(0b11), F.lit(0b01)])).first()[0]
    assert got == 0b0111


def test_a_hot_value_is_several_files(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), "id")
    sizes = along_curve(rows, ["k"], 8).groupBy(F.spark_partition_id()).count().collect()
    assert max(r[1] for r in sizes) <= 1000


def test_odd_rows_are_kept(spark):
    kind = "_curve int, s string, m map<string,int>, d date, x decimal(30,2)"
    rows = spark.createDataFrame([(None, None, None, None, None), (1, "", {"a": 1}, None, None),
                                  (1, "", {"a": 1}, None, None), (2, "ü", {}, None, None)], kind)
    for columns in (["_curve"], ["s", "_curve", "d", "x"]):
        for df in (rows, rows.limit(0)):
            got = along_curve(df, columns, 3)
            assert got.columns == rows.columns
            assert got.count() == df.count()
    with pytest.raises(ValueError, match="no order"):
        along_curve(rows, ["m"])
    with pytest.raises(ValueError, match="at most"):
        along_curve(rows, ["s"] * 11)
    with pytest.raises(ValueError, match="no columns"):
        along_curve(rows, [])


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    hf.create_namespace(spark, "bucketed_test", str(tmp_path / "ns"))
    held = []
    for name in ("parent", "child"):
        declared = hf.Contract.from_dict({
            "table": name, "schema": "bucketed_test", "order_by": ["k"],
            "columns": [{"name": "k", "type": "bigint"}, {"name": "v", "type": "text"}]})
        held.append(hf.create_table(spark, declared, bucket_by=("k",), buckets=4))
    parent, child = held
    parent.append(spark.range(100).select(F.col("id").alias("k"), F.lit("p").alias("v")))
    child.append(spark.range(50, 150).select(F.col("id").alias("k"), F.lit("c").alias("v")))
    orphans = hf.fk_orphans(child.read(), "k", parent.read(), "k")
    assert orphans.count() == 50
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = hf.fk_orphans(child.read(), "k", parent.read(), "k")
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in text and "Bucketed: true" in text
    with pytest.raises(ValueError, match="both columns and a number"):
        hf.create_table(spark, declared, bucket_by=("k",))


def test_json_becomes_variants(spark, folder):
    declared = hf.Contract.from_dict({"table": "t", "columns": [
        {"name": "k", "type": "integer"}, {"name": "j", "type": "json"},
        {"name": "n", "type": "json"}, {"name": "m", "type": "json", "default": "[1]"}]})
    rows = spark.createDataFrame([(1, '{"a": [1, 2]}', (7,)), (2, None, None), (3, "3", (None,))],
                                 "k int, j string, n struct<x: int>")
    table = hf.PathTable(spark, folder)
    table.append(hf.conform(rows, declared, variant=True))
    got = table.read().orderBy("k").select(
        F.try_variant_get("j", "$.a[1]", "int"), F.try_variant_get("n", "$.x", "int"),
        F.to_json("j"), F.to_json("m")).collect()
    assert [tuple(r) for r in got] == [(2, 7, '{"a":[1,2]}', "[1]"), (None, None, None, "[1]"),
                                       (None, None, "3", "[1]")]
    bad = spark.createDataFrame([(1, "{", (1,)), (2, "", None)],
                                "k int, j string, n struct<x: int>")
    report = hf.conform_report(bad, declared, variant=True).collect()
    assert {r["column"]: r["failures"] for r in report} == {"k": 0, "j": 2, "n": 0}
    with pytest.raises(PySparkException, match="no JSON"):
        hf.conform(bad, declared, variant=True).collect()
    plain = {r["column"]: r["failures"] for r in hf.conform_report(bad, declared).collect()}
    assert plain["j"] == 0
