import pytest
from pyspark.sql import functions as F

import haulframe as hf
from haulframe.sources.storage import Storage

SCHEMA = "id bigint, at timestamp_ntz, tags array<string>"


def arrive(spark, path, low, high):
    rows = spark.range(low, high).select(
        "id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("at"),
        F.array(F.lit("a\0b")).alias("tags"))
    rows.coalesce(2).write.mode("append").parquet(path)


def ids(target):
    return sorted(r.id for r in target.read().collect())


@pytest.fixture
def places(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "out", "checkpoint")}


def run(spark, places, **keys):
    schema = spark.createDataFrame([], SCHEMA).schema
    arrivals = hf.read_arrivals(spark, places["in"], schema, **keys)
    target = hf.PathTable(spark, places["out"])
    hf.run_arrivals(arrivals, target, places["checkpoint"])
    return target


def test_each_run_takes_what_is_new(spark, places):
    arrive(spark, places["in"], 0, 10)
    assert ids(run(spark, places)) == list(range(10))
    assert ids(run(spark, places)) == list(range(10))
    # The same mark as before: a high-water mark would lose these rows.
    arrive(spark, places["in"], 10, 15)
    target = run(spark, places, files_per_batch=1)
    assert ids(target) == list(range(15))
    assert target.read().first().tags == '["ab"]'


def test_a_replayed_batch_lands_once(spark, tmp_path):
    target = hf.PathTable(spark, str(tmp_path / "t"))
    assert target.append_batch(spark.range(10), "s-0").rows == 10
    assert target.append_batch(spark.range(10), "s-0").rows == 0
    target.append_batch(spark.range(10, 12), "s-1")
    assert ids(target) == list(range(12))


def test_a_batch_that_stopped_while_moving_is_finished(spark, tmp_path):
    target = hf.PathTable(spark, str(tmp_path / "t"))
    staged = f"{tmp_path}/.t.batch-s-0"
    target._stage(spark.range(10).repartition(4), staged)
    storage = Storage(spark, target.path)
    moved = [n for n in storage.files(staged) if n.startswith("part-")][0]
    storage.make_dir(target.path)
    storage.rename(f"{staged}/{moved}", f"{target.path}/{moved}")
    target.append_batch(spark.range(10).repartition(2), "s-0")
    assert ids(target) == list(range(10))


def test_a_batch_that_stopped_while_writing_is_written_again(spark, tmp_path):
    target = hf.PathTable(spark, str(tmp_path / "t"))
    spark.range(10).write.parquet(f"{tmp_path}/.t.batch-s-0")  # no marker
    target.append_batch(spark.range(10), "s-0")
    assert ids(target) == list(range(10))


def test_a_failing_batch_raises(spark, places):
    arrive(spark, places["in"], 0, 3)
    target = hf.PathTable(spark, places["out"])
    target.append(spark.sql("SELECT 1 AS other"))
    with pytest.raises(Exception, match="does not have|not have"):
        run(spark, places)


def test_streams_with_their_own_checkpoints_share_a_target(spark, places, tmp_path):
    arrive(spark, places["in"], 0, 10)
    run(spark, places)
    other = places | {"in": str(tmp_path / "in2"), "checkpoint": str(tmp_path / "checkpoint2")}
    arrive(spark, other["in"], 100, 150)
    target = run(spark, other)
    assert ids(target) == [*range(10), *range(100, 150)]
    # Replays add nothing, and what arrives later is still taken.
    for given in (places, other):
        run(spark, given)
    arrive(spark, places["in"], 10, 12)
    assert ids(run(spark, places)) == [*range(12), *range(100, 150)]


def test_a_new_checkpoint_is_a_new_stream(spark, places, tmp_path):
    arrive(spark, places["in"], 0, 5)
    run(spark, places)
    again = places | {"checkpoint": str(tmp_path / "fresh")}
    assert ids(run(spark, again)) == sorted([*range(5), *range(5)])


def test_the_ledger_keeps_one_number_for_each_stream(spark, tmp_path):
    target = hf.PathTable(spark, str(tmp_path / "t"))
    for i in range(4):
        target.append_batch(spark.range(i, i + 1), f"s-{i}")
    storage = Storage(spark, target.path)
    assert storage.list(f"{tmp_path}/.t.batches/s") == ["3"]
    assert target.append_batch(spark.range(9), "s-2").rows == 0  # a late replay
    # Stopped between the two writes of the ledger: the larger number counts.
    storage.create_empty(f"{tmp_path}/.t.batches/s/2")
    assert target.append_batch(spark.range(9), "s-3").rows == 0
    assert ids(target) == list(range(4))
