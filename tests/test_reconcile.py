import pytest
from pyspark.sql import functions as F

import haulframe as hf
from haulframe.operators.checks import constraint_report_fused
from haulframe.sources.splits import split_number, split_points, split_predicates

ROWS = "k int, g string, v double, tags array<string>"


def found(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_missing_extra_and_changed_keys(spark):
    source = spark.createDataFrame(
        [(1, "a", 1.0, ["x"]), (1, None, 2.0, None), (2, "b", 3.0, []), (None, "c", 4.0, None),
         (3, "d", 5.0, None), (4, "e", 6.0, None), (5, "f", None, None)], ROWS)
    target = spark.createDataFrame(
        [(1, "a", 1.0, ["x"]), (2, "b", 3.0, None), (None, "c", 4.0, None), (3, "d", 5.0, None),
         (3, "d", 5.0, None), (5, "f", 0.0, None), (6, None, 1.0, None), (None, None, 1.0, None)],
        ROWS)
    want = sorted([(1, None, "missing", 1, 0), (2, "b", "changed", 1, 1),
                   (3, "d", "changed", 1, 2), (4, "e", "missing", 1, 0),
                   (5, "f", "changed", 1, 1), (6, None, "extra", 0, 1),
                   (None, None, "extra", 0, 1)], key=str)
    for buckets in (1, 3, 4096):
        got = hf.reconcile_by_digest(source, target, ["k", "g"], buckets=buckets)
        assert found(got, "k", "g", "status", "source_rows", "target_rows") == want


def test_equal_sides_agree_whatever_their_order(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"),
                                   F.create_map(F.lit("a"), F.col("id")).alias("m"))
    other = rows.orderBy(F.desc("k")).repartition(5)
    assert hf.reconcile_by_digest(rows, other, ["k"]).count() == 0
    assert hf.reconcile_by_digest(rows.limit(0), other.limit(0), ["k"]).count() == 0
    assert hf.reconcile_by_digest(rows, other.withColumn("v", F.lit(0)), ["k"], []).count() == 0


@pytest.fixture
def declared():
    parent = hf.Contract.from_dict({"table": "parent", "columns": [
        {"name": "id", "type": "bigint", "primary_key": True},
        {"name": "code", "type": "varchar(2)", "unique": True}]})
    child = hf.Contract.from_dict({"table": "child", "columns": [
        {"name": "a", "type": "text", "primary_key": True},
        {"name": "b", "type": "text", "primary_key": True},
        {"name": "up", "type": "integer", "foreign_key": "parent(id)"},
        {"name": "x", "type": "double", "unique": True}]})
    return [parent, child]


def test_fused_checks_equal_the_separate_ones(spark, declared):
    parent = spark.createDataFrame([(1, "a"), (1, "abc"), (None, None), (2, None), (3, "a")],
                                   "id bigint, code string")
    child = spark.createDataFrame(
        [("1", "2:3", 1, 0.0), ("1:", "23", 9, -0.0), ("1", "2:3", None, None),
         (None, "x", 2, float("nan")), ("", "", 9, float("nan"))],
        "a string, b string, up int, x double")
    frames = {"parent": parent, "child": child}
    columns = ("table", "constraint", "column", "violations")
    want = found(hf.constraint_report(frames, declared), *columns)
    assert found(constraint_report_fused(frames, declared), *columns) == want
    assert sum(w[3] for w in want) == 10
    empty = {t: df.limit(0) for t, df in frames.items()}
    assert found(constraint_report_fused(empty, declared), *columns) == found(
        hf.constraint_report(empty, declared), *columns)


def test_fused_checks_scan_each_table_once(spark, declared, tmp_path):
    for name, kind in (("parent", "id bigint, code string"),
                       ("child", "a string, b string, up int, x double")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}")
    frames = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("parent", "child")}
    plan = constraint_report_fused(frames, declared)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Relation [") == 2


def test_splits_of_a_skewed_key_have_equal_depth(spark):
    rows = spark.range(20_000).select((F.col("id") * F.col("id") * F.col("id")).alias("k"))
    points = split_points(rows, "k", 10)
    kind = rows.schema["k"].dataType
    sizes = [r[1] for r in rows.groupBy(split_number("k", points, kind)).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 1.1 * 2000
    # The conditions a database gets part the rows alike.
    parted = [rows.where(p).count() for p in split_predicates("`k`", points, kind)]
    assert sorted(parted) == sorted(sizes)


def test_splits_hold_every_row_once(spark):
    rows = spark.createDataFrame([(None,), (None,), (5,), (5,), (5,), (5,), (7,)], "k int")
    points = split_points(rows, "k", 4)
    parted = [rows.where(p).count()
              for p in split_predicates("k", points, rows.schema["k"].dataType)]
    assert sum(parted) == 7
    assert split_points(rows.limit(0), "k", 4) == []
    assert split_predicates("k", [], rows.schema["k"].dataType) == ["1 = 1"]
    days = spark.sql("SELECT date_add(date'2024-01-01', int(id)) AS d FROM range(100)")
    points = split_points(days, "d", 2)
    assert sum(days.where(p).count() for p in split_predicates(
        "d", points, days.schema["d"].dataType)) == 100
    with pytest.raises(ValueError, match="no quantiles"):
        split_points(spark.createDataFrame([], "s string"), "s", 2)


def test_equal_depth_of_cubes_beyond_64_bits(spark, tmp_path):
    from catalogue.spark_queries import QUERIES

    rows = spark.range(0, 9_000_000, 9_000).select(
        F.col("id").alias("l_orderkey"), F.lit(2.0).alias("l_quantity"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["read_equal_depth"](spark, str(tmp_path)).first()
    assert tuple(found) == (8, 1000, 2000.0, True)
