import datetime as dt
import shutil
import warnings

import pytest
from pyspark.sql import functions as F

import haulframe as hf
from haulframe.plans.load import Decision
from haulframe.sources.storage import Storage

SCHEMA = "id int, at timestamp_ntz, v string"


def day(n):
    return dt.datetime(2024, 1, n)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def ids(target):
    return sorted(r.id for r in target.read().collect())


def incremental(column="at", **keys):
    return hf.LoadSpec("incremental", column, **keys)


@pytest.fixture
def source(spark):
    return frame(spark, (1, day(1), "a"), (2, day(2), "b"), (3, day(2), "c"), (4, day(3), "d"),
                 (5, None, "e"))


@pytest.fixture
def target(spark, folder):
    table = hf.PathTable(spark, folder)
    table.append(frame(spark, (1, day(1), "a"), (2, day(2), "b")))
    return table


@pytest.mark.parametrize("spec, expected", [
    (hf.LoadSpec(), Decision("full", True, False)),
    (hf.LoadSpec("full", "at", truncate=True), Decision("full", True, False)),
    (incremental(full_load=True), Decision("full", True, False)),
    (incremental(truncate=True), Decision("incremental", True, False)),
    (incremental(), Decision("incremental", False, True)),
    (incremental(None), Decision("full", False, False)),
    (incremental(None, truncate=True), Decision("full", True, False)),
])
def test_decision_table(spec, expected):
    assert hf.decide(spec) == expected


@pytest.mark.parametrize("spec, expected, rows", [
    (hf.LoadSpec(), [1, 2, 3, 4, 5], 5),
    (incremental(full_load=True), [1, 2, 3, 4, 5], 5),
    (incremental(truncate=True), [1, 2, 3, 4, 5], 5),
    # The tie at the mark (3) and the NULL mark (5) are not picked up.
    (incremental(), [1, 2, 4], 1),
])
def test_loads(source, target, spec, expected, rows):
    result = hf.load_table(source, target, spec=spec)
    assert ids(target) == expected
    assert result.rows == rows


def test_append_without_mark_duplicates_and_warns(source, target):
    with pytest.warns(UserWarning, match="appends every row"):
        hf.load_table(source, target, spec=incremental(None))
    assert ids(target) == [1, 1, 2, 2, 3, 4, 5]


def test_bootstrap_of_missing_empty_and_unmarked_targets(spark, tmp_path, source):
    missing = hf.PathTable(spark, str(tmp_path / "missing"))
    assert hf.load_table(source, missing, spec=incremental()).rows == 5
    empty = hf.PathTable(spark, str(tmp_path / "empty"))
    empty.append(source.limit(0))
    assert hf.load_table(source, empty, spec=incremental()).rows == 5
    unmarked = hf.PathTable(spark, str(tmp_path / "unmarked"))
    unmarked.append(frame(spark, (9, None, "z")))
    assert hf.load_table(source, unmarked, spec=incremental()).rows == 5
    assert ids(unmarked) == [1, 2, 3, 4, 5, 9]


def test_bare_folder_is_bootstrapped(spark, tmp_path, source):
    (tmp_path / "bare").mkdir()
    target = hf.PathTable(spark, str(tmp_path / "bare"))
    assert hf.load_table(source, target, spec=incremental()).rows == 5
    assert hf.load_table(source, target, spec=incremental()).rows == 0


def test_relative_folder(spark):
    assert hf.PathTable(spark, "orders")._appending == ".orders.append"
    assert hf.PathTable(spark, "/a/b/")._appending == "/a/.b.append"


def test_second_run_adds_nothing(source, target):
    hf.load_table(source, target, spec=incremental())
    again = hf.load_table(source, target, spec=incremental())
    assert again.rows == 0 and again.watermark == "2024-01-03 00:00:00"
    assert ids(target) == [1, 2, 4]


def test_empty_run_leaves_no_file(source, target):
    hf.load_table(source, target, spec=incremental())
    before = sorted(target._storage.files(target.path))
    hf.load_table(source, target, spec=incremental())
    assert sorted(target._storage.files(target.path)) == before


def test_missed_rows(source, target):
    hf.load_table(source, target, spec=incremental())
    assert sorted(r.id for r in hf.missed_rows(source, target.read(), ["id"]).collect()) == [3, 5]


def test_source_without_columns_never_empties(spark, target):
    result = hf.load_table(spark.range(1).select(), target, spec=hf.LoadSpec("full"))
    assert result.rows == 0 and ids(target) == [1, 2]


def test_failed_full_load_keeps_the_old_rows(spark, target):
    bad = frame(spark, (7, day(7), "x")).withColumn(
        "v", F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="boom"):
        hf.load_table(bad, target, spec=hf.LoadSpec("full"))
    assert ids(target) == [1, 2]


def test_interrupted_swap_is_undone(spark, source, target):
    storage = Storage(spark, target.path)
    parent, name = target.path.rsplit("/", 1)
    storage.rename(target.path, f"{parent}/.{name}.previous")
    assert hf.load_table(source, target, spec=incremental()).rows == 1
    assert ids(target) == [1, 2, 4]


def test_append_that_stopped_while_moving_is_finished(spark, source, target):
    """Without this the newest file's mark would hide the rows still to be moved."""
    late = frame(spark, (6, day(6), "f"), (7, day(7), "g"), (8, day(8), "h"))
    target._stage(late.repartitionByRange(3, "id"), target._appending)  # and no commit
    storage = Storage(spark, target.path)
    name = sorted(n for n in storage.files(target._appending) if n.startswith("part-"))[-1]
    storage.rename(f"{target._appending}/{name}", f"{target.path}/{name}")
    result = hf.load_table(source.unionAll(late), target, spec=incremental())
    assert result.rows == 0 and ids(target) == [1, 2, 6, 7, 8]


def test_append_that_stopped_while_writing_is_forgotten(spark, source, target):
    frame(spark, (9, day(9), "x")).write.parquet(target._appending)  # no marker
    assert hf.load_table(source, target, spec=incremental()).rows == 1
    assert ids(target) == [1, 2, 4]


def test_plain_append_finishes_an_earlier_one_first(spark, target):
    target._stage(frame(spark, (6, day(6), "f")), target._appending)
    target.append(frame(spark, (7, day(7), "g")))
    assert ids(target) == [1, 2, 6, 7]


def test_direct_append(spark, source, tmp_path):
    target = hf.PathTable(spark, str(tmp_path / "direct"), direct_append=True)
    for expected in (5, 0):
        assert hf.load_table(source, target, spec=incremental()).rows == expected


def test_partitioned_append(spark, source, tmp_path):
    declared = hf.Contract.from_dict({"table": "t", "partition_by": "v", "columns": [
        {"name": "id", "type": "integer"}, {"name": "at", "type": "timestamp"},
        {"name": "v", "type": "text"}]})
    target = hf.PathTable(spark, str(tmp_path / "t"), contract=declared)
    target.append(frame(spark, (1, day(1), "a"), (9, day(1), None)))
    hf.load_table(source, target, declared, incremental())
    assert ids(target) == [1, 2, 3, 4, 9]
    assert sorted(str(r.v) for r in target.read().collect()) == ["None", "a", "b", "c", "d"]


def test_reload_of_a_table_from_itself(target):
    hf.load_table(target, target, spec=hf.LoadSpec("full"))
    assert ids(target) == [1, 2]


def test_missing_mark_column_raises_instead_of_reloading(spark, source, target):
    with pytest.raises(ValueError, match="nope"):
        hf.load_table(source, target, spec=incremental("nope"))
    with pytest.raises(ValueError, match="later"):
        hf.load_table(source.withColumn("later", F.col("at")), target, spec=incremental("later"))
    assert ids(target) == [1, 2]


def test_mark_needs_an_order(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, ARRAY(1) AS a")
    with pytest.raises(ValueError, match="no order"):
        hf.load_table(df, hf.PathTable(spark, str(tmp_path / "t")), spec=incremental("a"))


@pytest.mark.parametrize("kind, values", [
    ("int", (1, 2, 3)), ("bigint", (1, 2, 2**62)), ("decimal(20,3)", ("1.5", "2.25", "3.125")),
    ("double", (0.1, 1e-5, 1e300)), ("string", ("a", "b'\\", "ç")),
    ("date", ("2024-01-01", "2024-02-01", "2024-03-01")),
    ("timestamp", ("2024-01-01 00:00:00.000001", "2024-06-01 12:00:00", "2024-07-01 00:00:00")),
    ("timestamp_ntz", ("2024-01-01 00:00:00", "2024-06-01 00:00:00.123456", "2025-01-01 00:00:00")),
])
def test_mark_of_every_type(spark, tmp_path, kind, values):
    df = spark.createDataFrame([(str(v),) for v in values], "raw string").select(
        F.col("raw").cast(kind).alias("m"))
    ordered = sorted(r.m for r in df.collect())
    target = hf.PathTable(spark, str(tmp_path / "t"))
    target.append(df.where(F.col("m") <= F.lit(ordered[1]).cast(kind)))
    result = hf.load_table(df, target, spec=incremental("m"))
    assert result.rows == 1
    assert sorted(r.m for r in target.read().collect()) == ordered


@pytest.mark.parametrize("zone", ["America/Sao_Paulo", "Asia/Tokyo", "UTC"])
def test_marks_do_not_move_with_the_session_zone(spark, tmp_path, monkeypatch, zone):
    """Both sides of a clock change, written and read under any zone."""
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 2018-02-18: the hour before midnight happened twice in Sao Paulo.
        micros = [1518918600000000, 1518922200000000, 1518925800000000]
        df = spark.createDataFrame([(m,) for m in micros], "m bigint").select(
            F.timestamp_micros("m").alias("at"), F.col("m"))
        target = hf.PathTable(spark, str(tmp_path / "t"))
        target.append(df.where(F.col("m") <= micros[1]))
        assert hf.load_table(df, target, spec=incremental("at")).rows == 1
        assert sorted(r.m for r in target.read().collect()) == micros
        events = hf.PathTable(spark, "/root/testdata/sf0.01/events.parquet").read()
        early = hf.PathTable(spark, str(tmp_path / "events"))
        early.append(events.where("ts <= timestamp_ntz'2024-01-15 00:00:00'"))
        late = events.where("ts > timestamp_ntz'2024-01-15 00:00:00'").count()
        assert hf.load_table(events, early, spec=incremental("ts")).rows == late
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_delta_is_pushed_down_and_written_in_mark_order(spark, tmp_path):
    events = hf.PathTable(spark, "/root/testdata/sf0.001/events.parquet")
    target = hf.PathTable(spark, str(tmp_path / "t"))
    target.append(events.read().where("ts <= timestamp_ntz'2024-01-10 00:00:00'"))
    plan = hf.incremental_delta(events, target, "ts")._jdf.queryExecution().executedPlan()
    assert "GreaterThan(ts," in plan.toString()
    mark = target.high_water_mark("ts")
    hf.load_table(events, target, spec=incremental("ts"))
    new = target.read_above("ts", mark).select("ts", F.input_file_name().alias("f"))
    in_file_order = new.withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()
    by_file = {}
    for row in in_file_order:
        by_file.setdefault(row.f, []).append(row.ts)
    assert by_file and all(marks == sorted(marks) for marks in by_file.values())


def test_mark_is_found_through_the_note_of_the_last_write(spark, tmp_path):
    target = hf.PathTable(spark, str(tmp_path / "t"))
    target.append(frame(spark, (1, day(1), "a"), (2, day(20), "b")))
    target.append(frame(spark, (3, day(9), "c")))
    assert target.high_water_mark("at") == "2024-01-20 00:00:00"
    target.append(frame(spark, (4, None, "d")), "at")
    assert target.high_water_mark("at") == "2024-01-20 00:00:00"
    target.append(frame(spark, (5, day(25), "e")), "at")
    target.append(frame(spark, (6, day(27), "f")))
    assert target._noted("at") == "2024-01-25 00:00:00"
    assert target.high_water_mark("at") == "2024-01-27 00:00:00"
    # Rows that went behind the table's back make the note too high; it must not be believed.
    target.replace(frame(spark, (1, day(3), "a")))
    assert target.high_water_mark("at") == "2024-01-03 00:00:00"


def test_append_by_name_fills_and_refuses(spark, target):
    target.append(spark.sql("SELECT 'z' AS v, 8 AS ID"))
    assert ids(target) == [1, 2, 8]
    with pytest.raises(ValueError, match="extra"):
        target.append(spark.sql("SELECT 9 AS id, 1 AS extra"))


def test_nested_values_load_as_json_unless_declared(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, ARRAY('a', 'b') AS tags")
    plain = hf.PathTable(spark, str(tmp_path / "plain"))
    hf.load_table(df, plain)
    assert plain.read().first().tags == '["a","b"]'
    declared = hf.contract_of("t", df.schema)
    nested = hf.PathTable(spark, str(tmp_path / "nested"), contract=declared)
    hf.load_table(df, nested, declared)
    assert nested.read().first().tags == ["a", "b"]


def test_conforming_load(spark, tmp_path):
    declared = hf.Contract.from_dict({"table": "t", "columns": [
        {"name": "id", "type": "bigint"}, {"name": "v", "type": "text", "default": "none"}]})
    target = hf.PathTable(spark, str(tmp_path / "t"), contract=declared)
    hf.load_table(spark.sql("SELECT '1' AS id"), target, declared,
                  options=hf.LoadOptions(conform=True))
    assert tuple(target.read().first()) == (1, "none")


def test_enforced_load_fails_before_writing(spark, target):
    declared = hf.Contract.from_dict({"table": "t", "columns": [
        {"name": "id", "type": "integer", "primary_key": True},
        {"name": "at", "type": "timestamp"},
        {"name": "v", "type": "varchar(1)", "nullable": False}],
        "schedule": {"mode": "incremental", "incremental_column": "at"}})
    rows = frame(target.spark, (2, day(5), "x"), (6, day(6), "long"), (7, day(7), None),
                 (8, day(8), "y"), (8, day(9), "y"))
    with pytest.raises(hf.ConstraintError) as caught:
        hf.load_table(rows, target, declared, options=hf.LoadOptions(enforce=True))
    found = {(v["constraint"], v["column"]): v["violations"] for v in caught.value.violations}
    assert found == {("not_null", "v"): 1, ("length", "v"): 1, ("primary_key", "id"): 1,
                     ("primary_key_held", "id"): 1}
    assert ids(target) == [1, 2]
    good = frame(target.spark, (6, day(6), "z"))
    assert hf.load_table(good, target, declared, options=hf.LoadOptions(enforce=True)).rows == 1


def chain(spark, names):
    return [hf.Contract.from_dict({"table": n, "columns": [
        {"name": "id", "type": "integer"},
        {"name": "up", "type": "integer", "foreign_key": f"{p}(id)" if p else None}]})
        for n, p in names]


def test_load_all_runs_parents_first(spark, tmp_path):
    contracts = chain(spark, [("c", "b"), ("b", "a"), ("a", None), ("x", None)])
    started = []

    def source(contract):
        started.append(contract.table)
        return spark.sql("SELECT 1 AS id, 1 AS up")

    results = hf.load_all(spark, contracts, source,
                          lambda c: hf.PathTable(spark, str(tmp_path / c.table)))
    assert {r.table: r.rows for r in results} == dict.fromkeys("abcx", 1)
    assert started.index("a") < started.index("b") < started.index("c")


def test_load_all_skips_children_of_a_failure(spark, tmp_path):
    contracts = chain(spark, [("a", None), ("b", "a"), ("c", "b"), ("x", None)])

    def source(contract):
        if contract.table == "a":
            raise RuntimeError("no such source")
        return spark.sql("SELECT 1 AS id, 1 AS up")

    with pytest.raises(hf.LoadError, match="no such source") as caught:
        hf.load_all(spark, contracts, source,
                    lambda c: hf.PathTable(spark, str(tmp_path / c.table)))
    assert [r.table for r in caught.value.results] == ["x"]
    assert list(caught.value.errors) == ["a"] and caught.value.skipped == ["b", "c"]


def test_load_all_takes_a_cycle_in_the_given_order(spark, tmp_path):
    contracts = chain(spark, [("b", "a"), ("a", "b"), ("c", None)])
    order = []

    def source(contract):
        order.append(contract.table)
        return spark.sql("SELECT 1 AS id, 1 AS up")

    hf.load_all(spark, contracts, source, lambda c: hf.PathTable(spark, str(tmp_path / c.table)))
    assert order == ["b", "a", "c"]


def test_load_all_checks_references_of_loaded_parents(spark, tmp_path):
    contracts = chain(spark, [("child", "parent"), ("parent", None)])
    rows = {"parent": "SELECT 1 AS id, 1 AS up", "child": "SELECT 5 AS id, 2 AS up"}
    with pytest.raises(hf.LoadError, match="foreign_key: 1"):
        hf.load_all(spark, contracts, lambda c: spark.sql(rows[c.table]),
                    lambda c: hf.PathTable(spark, str(tmp_path / c.table)),
                    hf.LoadOptions(enforce=True))
    assert not (tmp_path / "child").exists()


def test_report(spark, source, target):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        results = [hf.load_table(source, target, spec=incremental(), name="t")]
    assert [tuple(r) for r in hf.load_report(spark, results).collect()] == [
        ("t", "incremental", 1, "2024-01-03 00:00:00")]


def _families():
    return [hf.Contract.from_dict({"table": t, "columns": [
        {"name": "id", "type": "bigint", "primary_key": True},
        *([{"name": "up", "type": "bigint", "foreign_key": f"{up}(id)"}] if up else [])]})
        for t, up in (("a", None), ("b", "a"), ("c", "b"), ("d", None))]


def test_a_failed_run_resumes_where_it_stopped(spark, tmp_path):
    ledger = hf.RunLedger(spark, str(tmp_path / "runs"), "night 1/2")
    declared, read = _families(), []

    def attempt(broken=(), ledger=ledger, contracts=declared):
        read.clear()

        def source(contract):
            read.append(contract.table)
            if contract.table in broken:
                raise OSError("gone")
            return spark.sql("SELECT 1L AS id" + (", 1L AS up" * (contract.table in "bc")))

        return {r.table: r for r in hf.load_all(
            spark, contracts, source, lambda c: hf.PathTable(spark, str(tmp_path / c.table)),
            ledger=ledger)}

    with pytest.raises(hf.LoadError) as caught:
        attempt({"b"})
    assert {r.table for r in caught.value.results} == {"a", "d"}
    assert caught.value.skipped == ["c"]
    results = attempt()
    assert sorted(read) == ["b", "c"]
    assert {t for t, r in results.items() if r.resumed} == {"a", "d"}
    assert [(r.kind, r.rows) for r in results.values()] == [("full", 1)] * 4
    attempt()
    assert read == []
    # Another run, a changed contract and a lost target load again; nothing else does.
    attempt(ledger=hf.RunLedger(spark, str(tmp_path / "runs"), "night 2"))
    assert sorted(read) == ["a", "b", "c", "d"]
    changed = [c if c.table != "d" else hf.Contract.from_dict({"table": "d", "columns": [
        {"name": "id", "type": "bigint"}]}) for c in declared]
    attempt(contracts=changed)
    assert read == ["d"]
    shutil.rmtree(tmp_path / "a")
    attempt(contracts=changed)
    assert read == ["a"]


def test_a_run_needs_a_name(spark, tmp_path):
    with pytest.raises(ValueError, match="name"):
        hf.RunLedger(spark, str(tmp_path), "")
