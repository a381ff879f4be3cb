import pytest

import haulframe as hf
from haulframe.plans.project import read_env

ENV = """
# ends of the pipe
DB_ORIGEM_TYPE=parquet
DB_ORIGEM_HOST={source}
DB_ORIGEM_NAME=
DB_DESTINO_TYPE=parquet
DB_DESTINO_HOST={target}
DB_DESTINO_NAME=
DB_DESTINO_PASSWORD=a=b
"""
PARENTS = """
table: parents
description: kept
columns:
  - {name: id, type: bigint, primary_key: true, nullable: false}
  - {name: updated_at, type: timestamp}
"""
CHILDREN = """
table: children
owner: me
"""


@pytest.fixture
def project(spark, tmp_path):
    for name in ("source", "target", "project/schemas"):
        (tmp_path / name).mkdir(parents=True)
    folder = tmp_path / "project"
    (folder / ".env").write_text(ENV.format(source=tmp_path / "source",
                                            target=tmp_path / "target"))
    (folder / "main.yml").write_text(
        "tables:\n  - path: schemas/parents.yml\n  - path: schemas/children.yml\n")
    (folder / "schemas" / "parents.yml").write_text(PARENTS)
    (folder / "schemas" / "children.yml").write_text(CHILDREN)
    parents = spark.sql(
        "SELECT id, timestamp_ntz'2024-01-01 00:00:00' AS updated_at FROM range(5)")
    parents.write.parquet(str(tmp_path / "source" / "parents"))
    spark.sql("SELECT id, id % 3 AS parent_id FROM range(7)").write.parquet(
        str(tmp_path / "source" / "children"))
    return folder


def test_env_lines(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# c\n\nA = 1 \nB=x=y\nnothing\n")
    assert read_env(path) == {"A": "1", "B": "x=y"}


def test_project_describe_schedule_create_load(spark, project):
    opened = hf.Project.open(spark, project)
    assert [c.table for c in opened.contracts] == ["parents", "children"]
    assert opened.target.password == "a=b"
    assert opened.describe() == ["children"]
    opened.complete_schedules()
    opened = hf.Project.open(spark, project)
    parents, children = opened.contracts
    assert parents.load == hf.LoadSpec("incremental", "updated_at")
    assert parents.description == "kept"
    assert [(c.name, c.type) for c in children.columns] == [("id", "bigint"),
                                                            ("parent_id", "bigint")]
    assert children.load == hf.LoadSpec("full")
    assert "owner: me" in (project / "schemas" / "children.yml").read_text()
    assert opened.create_targets() == {"parents": True, "children": True}
    assert opened.create_targets() == {"parents": False, "children": False}
    assert {r.table: (r.kind, r.rows) for r in opened.load_all()} == {
        "parents": ("incremental", 5), "children": ("full", 7)}
    assert opened.load("parents").rows == 0
    assert opened.load("children").rows == 7
    assert opened.target_table(children).read().count() == 7
    with pytest.raises(KeyError):
        opened.load("strangers")


def test_describe_again_on_request(spark, project):
    opened = hf.Project.open(spark, project)
    assert opened.describe("parents") in ([], ["parents"])
    assert opened.contracts[0].column("updated_at").type == "timestamp"
