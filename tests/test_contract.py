import pytest
from pyspark.sql import types as T

from haulframe import (
    Contract,
    ColumnSpec,
    ForeignKey,
    LoadSpec,
    contract_of,
    in_parent_order,
    infer_watermark,
    read_contract,
    read_manifest,
    write_contract,
)

SALES = """
table: sales
schema: shop
owner: finance
schedule: {mode: incremental, incremental_column: sold_at, truncate: false}
columns:
  - {name: sale, type: bigint, primary_key: true, nullable: false}
  - {name: buyer, type: bigint, foreign_key: people(id), nullable: false}
  - {name: amount, type: "numeric(10, 2)"}
  - {name: sold_at, type: timestamp, default: now()}
"""


def column(name, kind="integer", **keys):
    return ColumnSpec(name, kind, **keys)


def table(name, *parents):
    return Contract(name, tuple(
        column(f"{p}_id", foreign_key=ForeignKey(p, "id")) for p in parents))


def test_yaml_contract(tmp_path, spark):
    path = tmp_path / "sales.yml"
    path.write_text(SALES, encoding="utf-8")
    contract = read_contract(path)
    assert contract.primary_key == ["sale"]
    assert contract.parents == ["people"]
    assert contract.load == LoadSpec("incremental", "sold_at")
    struct = contract.to_struct()
    assert struct["amount"].dataType == T.DecimalType(10, 2)
    assert not struct["sale"].nullable and struct["sold_at"].nullable
    assert struct["buyer"].metadata["foreign_key"] == "people(id)"
    write_contract(contract, path)
    assert read_contract(path) == contract
    assert "owner: finance" in path.read_text(encoding="utf-8")


def test_manifest_order_and_fallback(tmp_path):
    schemas = tmp_path / "schemas"
    schemas.mkdir()
    (schemas / "b.yml").write_text("table: b\ncolumns: [{name: id, type: integer}]\n")
    (schemas / "a.yml").write_text("table: a\n")
    (schemas / "c.yml").write_text("description: no table\n")
    assert [c.table for c in read_manifest(tmp_path)] == ["a", "b"]
    assert [c.table for c in read_manifest(tmp_path, with_columns=True)] == ["b"]
    (tmp_path / "main.yml").write_text(
        "tables:\n  - path: schemas/b.yml\n  - path: schemas/gone.yml\n  - path: schemas/a.yml\n")
    assert [c.table for c in read_manifest(tmp_path)] == ["b", "a"]


def test_foreign_key_texts():
    assert ForeignKey.parse("sales.orders(id)") == ForeignKey("orders", "id", "sales")
    assert str(ForeignKey.parse("orders(id)")) == "orders(id)"
    assert ForeignKey.parse(None) is None
    assert ForeignKey.parse({"table": "a b", "column": "c.d"}) == ForeignKey("a b", "c.d")
    with pytest.raises(ValueError, match="orders"):
        ForeignKey.parse("orders.id")


def test_unknown_mode_is_an_error():
    with pytest.raises(ValueError, match="hourly"):
        LoadSpec("hourly")


@pytest.mark.parametrize("columns, expected", [
    ([("id", "integer"), ("Updated_At", "timestamp"), ("created_at", "timestamp")], "Updated_At"),
    ([("criado_em", "timestamp"), ("atualizado_em", "timestamp")], "atualizado_em"),
    ([("data_pedido", "timestamp"), ("created", "date")], "created"),
    ([("id", "integer"), ("seen", "timestamptz"), ("born", "date")], "seen"),
    ([("data", "json"), ("born", "date")], "born"),
    ([("data", "text")], "data"),
    ([("id", "integer"), ("name", "text")], None),
    ([("t", "array<timestamp>")], None),
])
def test_watermark_inference(spark, columns, expected):
    assert infer_watermark([column(n, k) for n, k in columns]) == expected


def test_load_spec_completion(spark):
    columns = [column("id"), column("updated_at", "timestamp")]
    assert LoadSpec.complete(None, columns) == LoadSpec("incremental", "updated_at")
    assert LoadSpec.complete(None, columns[:1]) == LoadSpec("full")
    kept = LoadSpec.complete({"mode": "full", "cron": "5 4 * * *", "truncate": True}, columns)
    assert (kept.mode, kept.cron, kept.truncate) == ("full", "5 4 * * *", True)
    own = LoadSpec.complete({"mode": "incremental", "incremental_column": "id"}, columns)
    assert own.incremental_column == "id"
    empty = LoadSpec.complete({"mode": "incremental", "incremental_column": ""}, columns)
    assert empty.incremental_column == "updated_at"


def test_parent_order():
    tables = [table("lines", "orders", "parts"), table("orders", "customers"), table("parts"),
              table("customers"), table("loose", "elsewhere"), table("self", "self")]
    names = [c.table for c in in_parent_order(tables)]
    assert names == ["parts", "customers", "loose", "self", "orders", "lines"]
    cycle = [table("b", "a"), table("a", "b"), table("c")]
    assert in_parent_order(cycle) == cycle


def test_order_follows_last_parent():
    tables = [table("a"), table("b"), table("c", "b"), table("d", "a")]
    assert [c.table for c in in_parent_order(tables)] == ["a", "b", "d", "c"]


def test_layout_keys_and_schema():
    contract = Contract.from_dict({
        "table": "t", "columns": [{"name": "id", "type": "int", "primary_key": True}],
        "order_by": "(ts, `id`)", "partition_by": ["day"]})
    assert contract.order_by == ("ts", "id") and contract.partition_by == ("day",)
    assert Contract.from_dict({"table": "t", "columns": [
        {"name": "id", "type": "int", "primary_key": True}]}).sort_columns == ("id",)
    assert contract.target_schema() == "public"
    assert contract.target_schema("dbo") == "dbo"
    assert Contract("t", schema="own").target_schema("dbo") == "own"


def test_contract_of_live_schema(spark):
    live = spark.sql("SELECT 1 AS id, CAST('2024-01-01' AS TIMESTAMP_NTZ) AS updated_at, "
                     "ARRAY(1) AS tags").schema
    contract = contract_of("t", live)
    assert [(c.name, c.type) for c in contract.columns] == [
        ("id", "integer"), ("updated_at", "timestamp"), ("tags", "array<int>")]
    assert contract.load == LoadSpec("incremental", "updated_at")
