import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import haulframe as hf
from haulframe.operators import references
from haulframe.sources import storage


def contract(table, *columns):
    return hf.Contract.from_dict({"table": table, "columns": list(columns)})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(params=["broadcast", "shuffle"])
def join_way(request, monkeypatch):
    """Run a test with small key sets broadcast, and with none small enough."""
    if request.param == "shuffle":
        monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    return request.param


def test_pk_duplicates_composite(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (2, None)], "x int, y string")
    assert rows(hf.pk_duplicates(df, ["x", "y"])) == [(1, "a", 2)]


def test_unique_lets_null_repeat(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (None,), (None,)], "`odd name` int")
    assert rows(hf.unique_violations(df, "odd name")) == [(1, 3)]


def test_null_and_length_in_one_pass(spark):
    df = spark.createDataFrame([(1, "abc", "é"), (None, "abcd", None), (None, None, "éé")],
                               "id int, v string, c string")
    declared = contract("t", {"name": "id", "type": "integer", "primary_key": True},
                        {"name": "v", "type": "varchar(3)", "nullable": False},
                        {"name": "c", "type": "char(1)"})
    assert rows(hf.null_violations(df, declared)) == [("t", "not_null", "id", 2),
                                                      ("t", "not_null", "v", 1)]
    assert rows(hf.length_violations(df, declared)) == [("t", "length", "c", 1),
                                                        ("t", "length", "v", 1)]
    plan = hf.length_violations(df, declared)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


def test_foreign_key_rows(spark, join_way):
    # One key holds most rows: it must come out whole on either way.
    child = spark.createDataFrame(
        [(i, 1) for i in range(500)] + [(900, 2), (901, 2), (902, 3), (903, None)]
        + [(1000 + i, 7) for i in range(300)], "key int, fk int")
    parent = spark.createDataFrame([(1,), (1,), (3,), (None,)], "id int")
    assert rows(hf.fk_orphans(child, "fk", parent, "id")) == [(2, 2), (7, 300)]
    valid = hf.fk_valid_rows(child, "fk", parent, "id")
    assert valid.columns == ["key", "fk"]
    assert sorted(r["key"] for r in valid.collect()) == [*range(500), 902, 903]
    invalid = hf.fk_invalid_rows(child, "fk", parent, "id")
    assert sorted(r["key"] for r in invalid.collect()) == [900, 901, *range(1000, 1300)]


def test_hot_keys_stay_out_of_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(references, "HOT_SHARE", 3)
    child = spark.range(900).select(F.when(F.col("id") < 600, F.lit(-1)).otherwise(F.col("id"))
                                    .alias("fk"))
    parent = spark.range(700).select("id")
    assert hf.fk_invalid_rows(child, "fk", parent, "id").count() == 600 + 200
    valid = hf.fk_valid_rows(child, "fk", parent, "id")
    assert valid.count() == 100
    assert "BroadcastHashJoin" in valid._jdf.queryExecution().executedPlan().toString()


def test_child_rows_are_not_shuffled(spark):
    child = spark.range(1000).select((F.col("id") % 7).alias("fk"), "id")
    valid = hf.fk_valid_rows(child, "fk", spark.range(3).select("id"), "id")
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_key_conflicts(spark, join_way):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "x int, y string")
    held = spark.createDataFrame([(2, "b"), (2, "b"), (3, None), (9, "z")], "y2 int, w string")
    held = held.select(F.col("y2").alias("x"), F.col("w").alias("y"))
    assert rows(hf.key_conflicts(new, held, ["x", "y"])) == [(2, "b")]
    assert rows(hf.key_conflicts(new.select("x"), held, ["x"])) == [(2,), (3,)]
    assert rows(hf.key_conflicts(new.limit(0).select("x"), held, ["x"])) == []


def test_report_counts_rows_a_database_would_refuse(spark):
    people = contract("people", {"name": "id", "type": "integer", "primary_key": True},
                      {"name": "mail", "type": "varchar(3)", "unique": True},
                      {"name": "boss", "type": "integer", "foreign_key": "people(id)"})
    orders = contract("orders", {"name": "id", "type": "integer", "primary_key": True},
                      {"name": "who", "type": "integer", "foreign_key": "people(id)"},
                      {"name": "where", "type": "integer", "foreign_key": "shops(id)"})
    frames = {
        "people": spark.createDataFrame(
            [(1, "a", None), (2, "a", 1), (2, "a", 9), (None, "long", 1)],
            "id int, mail string, boss int"),
        "orders": spark.createDataFrame([(1, 1, 5), (2, 8, 5), (3, 8, 5), (4, None, 5)],
                                        "id int, who int, `where` int"),
    }
    found = {(r.table, r.constraint, r.column): r.violations
             for r in hf.constraint_report(frames, [people, orders]).collect()}
    assert found == {
        ("people", "not_null", "id"): 1, ("people", "length", "mail"): 1,
        ("people", "primary_key", "id"): 1, ("people", "unique", "mail"): 2,
        ("people", "foreign_key", "boss"): 1,
        ("orders", "not_null", "id"): 0, ("orders", "primary_key", "id"): 0,
        ("orders", "foreign_key", "who"): 2,
    }
    lost = {(r.child, r.column): r.orphan_rows for r in
            hf.fk_report(frames, [people, orders]).collect()}
    assert lost == {("people", "boss"): 1, ("orders", "who"): 2}


def test_only_keys_are_shuffled_when_nothing_fits_a_broadcast(spark):
    """Both sides reach the exchange as distinct keys, so a hot key is one row per task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
        orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
        found = hf.fk_orphans(lines, "l_orderkey", orders, "o_orderkey")
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        exchanges = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
        assert len(exchanges) == 2
        assert all("HashAggregate" in plan[i + 1] for i in exchanges)
        assert "l_partkey" not in "\n".join(plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_python_on_the_data_path(spark):
    import __spark_entry__ as registered

    for name in ("conform_types", "nested_to_json", "pk_duplicates", "strip_nul"):
        df = registered.queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_random_keys_match_brute_force(spark, join_way):
    draw = random.Random(11)
    keys = [None, *range(40)]
    # A third of the rows share one key.
    child = [(i, 3 if draw.random() < 0.33 else draw.choice(keys)) for i in range(3000)]
    parent = draw.choices(range(60), k=30)
    rows_in = spark.createDataFrame(child, "id int, fk int").repartition(5)
    held = spark.createDataFrame([(p,) for p in parent], "pk int")
    known = set(parent)
    lost = Counter(fk for _, fk in child if fk is not None and fk not in known)
    assert dict(tuple(r) for r in hf.fk_orphans(rows_in, "fk", held, "pk").collect()) == lost
    valid = sorted(r.id for r in hf.fk_valid_rows(rows_in, "fk", held, "pk").collect())
    assert valid == [i for i, fk in child if fk is None or fk in known]
    invalid = sorted(r.id for r in hf.fk_invalid_rows(rows_in, "fk", held, "pk").collect())
    assert invalid == [i for i, fk in child if fk is not None and fk not in known]
    repeats = {fk: n for fk, n in Counter(fk for _, fk in child).items()
               if fk is not None and n > 1}
    assert dict(tuple(r) for r in hf.unique_violations(rows_in, "fk").collect()) == repeats
    clashes = hf.key_conflicts(rows_in.select("fk"), held.withColumnRenamed("pk", "fk"), ["fk"])
    assert sorted(r.fk for r in clashes.collect()) == sorted(
        known & {fk for _, fk in child if fk is not None})
