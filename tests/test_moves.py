"""Atomic loads of database tables: the statements on an engine that runs here, and the order of
steps around them. The writer itself needs a database that all tasks reach."""

import duckdb
import pytest

import haulframe as hf
from haulframe.sources import tables
from haulframe.sources.tables import PLACE, move_statements


@pytest.fixture
def postgres():
    return hf.Connection("postgresql", host="h", database="d")


def test_a_repeated_task_adds_nothing(postgres):
    held = duckdb.connect()
    held.execute('CREATE TABLE "t" ("a b" INT, "v" TEXT)')
    held.execute('INSERT INTO "t" VALUES (0, \'old\')')
    held.execute(f'CREATE TABLE "s" ({PLACE[0]} BIGINT, {PLACE[1]} BIGINT, "a b" INT, "v" TEXT)')
    rows = [(7, 0, 1, "x"), (7, 1, 1, "x"), (8, 0, None, None)]
    for row in rows + rows[:2]:  # the first task committed, and ran again
        held.execute('INSERT INTO "s" VALUES (?, ?, ?, ?)', row)
    for statement in move_statements(postgres, '"t"', '"s"', ["a b", "v"], False):
        held.execute(statement)
    want = [(0, "old"), (1, "x"), (1, "x"), (None, None)]
    assert sorted(held.execute('SELECT * FROM "t"').fetchall(), key=str) == sorted(want, key=str)
    for statement in move_statements(postgres, '"t"', '"s"', ["a b", "v"], True):
        held.execute(statement)
    assert sorted(held.execute('SELECT * FROM "t"').fetchall(), key=str) == sorted(want[1:],
                                                                                   key=str)


class Recorded(hf.JdbcTable):
    """A table whose writes and statements are noted instead of sent."""

    def exists(self):
        return True

    def target_schema(self, held=None):
        return None

    def columns(self):
        return self.kind

    def _writer(self, df, mode, into=None):
        self.sent.append((into, df))
        return self

    def save(self):
        if self.broken:
            raise RuntimeError("lost")
        into, df = self.sent[-1]
        self.rows = df.collect()

    def _execute(self, *statements):
        self.run.append(statements)


@pytest.mark.parametrize("broken", [False, True])
def test_a_load_is_one_transaction(spark, postgres, broken):
    rows = spark.range(5).selectExpr("id AS k", "'v' AS v")
    table = Recorded(spark, postgres, "t", atomic=True, write_tasks=2)
    table.kind, table.sent, table.run, table.broken = rows.schema, [], [], broken
    if broken:
        with pytest.raises(RuntimeError, match="lost"):
            table.append(rows)
        assert len(table.run) == 1 and table.run[0][0].startswith("DROP TABLE")
        return
    assert table.append(rows, "k") == hf.Written(5, "4")
    into = table.sent[0][0]
    assert into.startswith('"public"."hf_load_') and len(table.sent) == 1
    places = {(r[PLACE[0]], r[PLACE[1]]) for r in table.rows}
    assert len(places) == 5 and sorted(r.k for r in table.rows) == list(range(5))
    (moved,), (dropped,) = table.run
    assert moved.startswith('INSERT INTO "public"."t" ("k", "v") SELECT "k", "v" FROM (SELECT')
    assert dropped == f"DROP TABLE {into}"
    table.run.clear()
    table.replace(rows)
    assert [s.split()[0] for s in table.run[0]] == ["DELETE", "INSERT"]
    assert tables.PLACE[0] not in rows.columns
