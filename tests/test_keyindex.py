import random

import pytest
from pyspark.sql import functions as F

import haulframe as hf
from haulframe.sources.keyindex import Candidates, KeyIndex


def held(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def target(spark, folder):
    """Ten files whose key ranges all overlap."""
    table = hf.PathTable(spark, folder)
    for i in range(10):
        table.append(spark.range(2000).select((F.col("id") * 10 + i).alias("k"),
                                              F.lit(i).alias("v")).coalesce(1))
    return table


def test_only_files_that_may_hold_a_key_are_opened(spark, target):
    index = KeyIndex(target, ["k"])
    assert index.refresh() == 10 and index.refresh() == 0
    delta = spark.createDataFrame([(13,), (10_023,), (10_023,), (None,), (-5,), (10**9,)], "k long")
    found = index.candidates(delta)
    assert found.files == 10 and 1 <= len(found.paths) <= 2
    assert held(index.conflicts(delta)) == [(13,), (10_023,)]
    opened = index.read(found).select(F.col("_metadata.file_path")).distinct().count()
    assert opened == len(found.paths)


def test_equals_the_search_without_an_index(spark, target):
    index = KeyIndex(target, ["k"])
    index.refresh()
    random.seed(3)
    for n in (0, 50, 3000):
        delta = spark.createDataFrame([(random.randrange(-5000, 40_000),) for _ in range(n)],
                                      "k int")
        assert held(index.conflicts(delta)) == held(
            hf.key_conflicts(delta, target.read(), ["k"]))


def test_files_without_an_entry_are_opened(spark, target):
    index = KeyIndex(target, ["k"])
    delta = spark.createDataFrame([(77,), (500_000,)], "k long")
    assert index.candidates(delta).skipped == 0
    assert held(index.conflicts(delta)) == [(77,)]
    index.refresh()
    target.append(spark.createDataFrame([(500_000, 1)], "k long, v int").repartition(2))
    assert held(index.conflicts(delta)) == [(77,), (500_000,)]
    # An empty file has an entry as well.
    assert index.refresh() >= 1 and index.refresh() == 0
    assert len(index.candidates(delta).paths) <= 4
    target.replace(spark.createDataFrame([(5, 1)], "k long, v int").coalesce(1))
    assert held(index.conflicts(delta)) == []
    assert index.refresh() == 1 and index.candidates(delta) == Candidates([], 1)


def test_keys_of_several_columns_in_a_partitioned_table(spark, folder):
    rows = [("a b", 1, 0.0, "x"), ("a b", 2, 1.5, "y"), ("ü%", 1, None, "z"), (None, 3, 2.5, "n")]
    kind = "p string, a int, b double, s string"
    declared = spark.createDataFrame([], kind).schema
    table = hf.PathTable(spark, folder, schema=declared, partition_by=("p",))
    table.append(spark.createDataFrame(rows, kind))
    index = KeyIndex(table, ["p", "b"])
    assert index.refresh() == 3
    delta = spark.createDataFrame([("a b", 1, -0.0, ""), ("ü%", 1, None, ""), ("c", 1, 2.5, "")],
                                  kind)
    assert held(index.conflicts(delta)) == [("a b", 0.0)]
    assert len(index.candidates(delta).paths) == 1
    assert held(index.conflicts(delta.limit(0))) == []


def test_other_types_are_refused(spark, target):
    index = KeyIndex(target, ["k"])
    index.refresh()
    with pytest.raises(ValueError, match="k is string"):
        index.candidates(spark.createDataFrame([("1",)], "k string"))
    with pytest.raises(ValueError, match="at least one key"):
        KeyIndex(target, [])
