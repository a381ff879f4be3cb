"""Table contracts: columns, keys and how a table is loaded."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

from haulframe.functions.types import (
    contract_type,
    contract_type_of,
    is_orderable,
    max_length,
    spark_type,
)

# Column names taken as the high-water mark, best first.
UPDATE_NAMES = (
    "updated_at", "updatedat", "updated", "update_timestamp", "last_updated",
    "lastupdate", "last_modified", "modified_at", "modified",
    "atualizado_em", "alterado_em", "data_atualizacao", "data_alteracao",
    "ultima_atualizacao", "dt_atualizacao", "dt_update",
)
CREATION_NAMES = (
    "created_at", "created", "create_timestamp", "inserted_at", "inserted",
    "criado_em", "data_criacao", "createddate", "dt_criacao", "data_inclusao",
    "data_pedido", "data", "date",
)
TEMPORAL_TYPES = ("timestamp", "timestamptz", "date", "time", "timetz")
DEFAULT_CRON = "0 * * * *"
MODES = ("full", "incremental")

_REFERENCE = re.compile(r"^(?:(\w+)\.)?(\w+)\((\w+)\)$")


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    schema: str | None = None

    @classmethod
    def parse(cls, value: Any) -> "ForeignKey | None":
        """``[schema.]table(column)``, or a mapping for names that need quoting."""
        if not value:
            return None
        if isinstance(value, ForeignKey):
            return value
        if isinstance(value, dict):
            return cls(value["table"], value["column"], value.get("schema"))
        found = _REFERENCE.match(str(value).strip())
        if not found:
            raise ValueError(f"foreign key {value!r} is not [schema.]table(column)")
        return cls(found.group(2), found.group(3), found.group(1))

    def __str__(self) -> str:
        return f"{self.schema + '.' if self.schema else ''}{self.table}({self.column})"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    default: Any = None
    foreign_key: ForeignKey | None = None

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> "ColumnSpec":
        return cls(
            name=str(raw["name"]), type=str(raw["type"]),
            nullable=bool(raw.get("nullable", True)),
            primary_key=bool(raw.get("primary_key")), unique=bool(raw.get("unique")),
            default=raw.get("default"), foreign_key=ForeignKey.parse(raw.get("foreign_key")),
        )

    def to_dict(self) -> dict[str, Any]:
        raw: dict[str, Any] = {"name": self.name, "type": self.type}
        if self.primary_key:
            raw["primary_key"] = True
        raw["nullable"] = self.nullable
        if self.unique:
            raw["unique"] = True
        if self.default not in (None, ""):
            raw["default"] = self.default
        if self.foreign_key:
            raw["foreign_key"] = str(self.foreign_key)
        return raw

    @property
    def required(self) -> bool:
        return self.primary_key or not self.nullable

    @property
    def has_default(self) -> bool:
        return self.default is not None and self.default != ""

    @property
    def spark_type(self) -> T.DataType:
        return spark_type(self.type)

    @property
    def max_length(self) -> int | None:
        return max_length(self.type)


@dataclass(frozen=True)
class LoadSpec:
    """How a table is loaded. ``cron`` is carried for an outside scheduler."""

    mode: str = "full"
    incremental_column: str | None = None
    full_load: bool = False
    truncate: bool = False
    cron: str = DEFAULT_CRON

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"load mode {self.mode!r} is not one of {MODES}")

    @classmethod
    def from_dict(cls, raw: dict[str, Any] | None) -> "LoadSpec":
        raw = raw or {}
        return cls(
            mode=raw.get("mode") or "full",
            incremental_column=raw.get("incremental_column") or None,
            full_load=bool(raw.get("full_load")), truncate=bool(raw.get("truncate")),
            cron=raw.get("cron") or DEFAULT_CRON,
        )

    @classmethod
    def complete(cls, raw: dict[str, Any] | None, columns: list[ColumnSpec]) -> "LoadSpec":
        """Fill only the keys the user left out, inferring the mark column."""
        given = {k: v for k, v in (raw or {}).items() if v is not None}
        mark = infer_watermark(columns)
        given.setdefault("mode", "incremental" if mark else "full")
        if mark:
            if not given.get("incremental_column") and (
                given["mode"] == "incremental" or "incremental_column" not in given
            ):
                given["incremental_column"] = mark
        return cls.from_dict(given)

    def to_dict(self) -> dict[str, Any]:
        raw: dict[str, Any] = {
            "cron": self.cron, "mode": self.mode,
            "full_load": self.full_load, "truncate": self.truncate,
        }
        if self.incremental_column:
            raw["incremental_column"] = self.incremental_column
        return raw


@dataclass(frozen=True)
class Contract:
    table: str
    columns: tuple[ColumnSpec, ...] = ()
    schema: str | None = None
    description: str = ""
    load: LoadSpec = field(default_factory=LoadSpec)
    engine: str | None = None
    order_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> "Contract":
        return cls(
            table=str(raw["table"]),
            columns=tuple(ColumnSpec.from_dict(c) for c in raw.get("columns") or ()),
            schema=raw.get("schema") or None, description=raw.get("description") or "",
            load=LoadSpec.from_dict(raw.get("schedule")), engine=raw.get("engine") or None,
            order_by=_names(raw.get("order_by")), partition_by=_names(raw.get("partition_by")),
        )

    def to_dict(self) -> dict[str, Any]:
        raw: dict[str, Any] = {"table": self.table}
        if self.schema:
            raw["schema"] = self.schema
        if self.description:
            raw["description"] = self.description
        raw["schedule"] = self.load.to_dict()
        if self.engine:
            raw["engine"] = self.engine
        if self.order_by:
            raw["order_by"] = list(self.order_by)
        if self.partition_by:
            raw["partition_by"] = list(self.partition_by)
        raw["columns"] = [c.to_dict() for c in self.columns]
        return raw

    @property
    def primary_key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]

    @property
    def uniques(self) -> list[str]:
        return [c.name for c in self.columns if c.unique]

    @property
    def foreign_keys(self) -> list[tuple[str, ForeignKey]]:
        return [(c.name, c.foreign_key) for c in self.columns if c.foreign_key]

    @property
    def parents(self) -> list[str]:
        """Referenced tables other than this one, first seen first."""
        return list(dict.fromkeys(
            fk.table for _, fk in self.foreign_keys if fk.table != self.table
        ))

    @property
    def key(self) -> tuple[str | None, str]:
        """What tells this table from others of its name."""
        return self.schema, self.table

    @property
    def sort_columns(self) -> tuple[str, ...]:
        """Physical order of rows: the declared one, else the primary key."""
        return self.order_by or tuple(self.primary_key)

    def column(self, name: str) -> ColumnSpec:
        for spec in self.columns:
            if spec.name == name:
                return spec
        raise KeyError(f"{self.table} has no column {name!r}")

    def to_struct(self) -> T.StructType:
        """Schema of the target, with keys and defaults as field metadata."""
        return T.StructType([
            T.StructField(c.name, c.spark_type, not c.required, {
                k: v for k, v in (
                    ("contract_type", c.type), ("primary_key", c.primary_key),
                    ("unique", c.unique), ("default", None if c.default is None
                                           else str(c.default)),
                    ("foreign_key", str(c.foreign_key) if c.foreign_key else None),
                ) if v
            })
            for c in self.columns
        ])

    def target_schema(self, default: str | None = None) -> str:
        """Namespace to write to: the contract's own, then the connection's, then public."""
        return self.schema or default or "public"

    def with_load(self, load: LoadSpec) -> "Contract":
        return replace(self, load=load)


def _names(value: Any) -> tuple[str, ...]:
    """``[a, b]``, ``"(a, b)"`` or ``"a, b"`` as column names."""
    if not value:
        return ()
    if isinstance(value, (list, tuple)):
        return tuple(str(v) for v in value)
    text = str(value).strip()
    if text.startswith("(") and text.endswith(")"):
        text = text[1:-1]
    # Commas inside an expression's brackets do not separate.
    return tuple(part.strip().strip('`"') for part in re.split(r",(?![^(]*\))", text)
                 if part.strip())


def columns_of(struct: T.StructType) -> tuple[ColumnSpec, ...]:
    """Column contracts a live schema implies."""
    return tuple(
        ColumnSpec(f.name, contract_type_of(f), nullable=f.nullable) for f in struct.fields
    )


def contract_of(table: str, struct: T.StructType, schema: str | None = None,
                **keys: Any) -> Contract:
    """Contract of a live table, with its load spec inferred."""
    columns = columns_of(struct)
    return Contract(table, columns, schema, load=LoadSpec.complete(None, list(columns)), **keys)


def merge_described(given: Contract, described: Contract) -> Contract:
    """Fresh columns under what a user already edited: a column that was known keeps its keys,
    uniqueness, default and reference; one the source no longer has goes."""
    known = {c.name: c for c in given.columns}
    columns = tuple(_keeping(c, known[c.name]) if c.name in known else c
                    for c in described.columns)
    return replace(
        given, columns=columns, schema=given.schema or described.schema,
        description=given.description or f"Table {given.table}",
    )


def _keeping(fresh: ColumnSpec, known: ColumnSpec) -> ColumnSpec:
    return replace(
        fresh, primary_key=fresh.primary_key or known.primary_key,
        unique=fresh.unique or known.unique,
        nullable=fresh.nullable and (known.nullable or known.primary_key),
        default=known.default if known.has_default else fresh.default,
        foreign_key=known.foreign_key or fresh.foreign_key)


# Place of each known name; lower is better.
_NAME_RANK = {name: rank for rank, name in enumerate(UPDATE_NAMES + CREATION_NAMES)}


def infer_watermark(columns: list[ColumnSpec] | tuple[ColumnSpec, ...]) -> str | None:
    """Mark column: the best ranked name in any case, else the first temporal column."""
    ranked = []
    for place, spec in enumerate(columns):
        rank = _NAME_RANK.get(spec.name.lower())
        if rank is None and contract_type(spec.type).split("(")[0] in TEMPORAL_TYPES:
            rank = len(_NAME_RANK)
        if rank is not None and _can_mark(spec.type):
            ranked.append((rank, place, spec.name))
    return min(ranked)[2] if ranked else None


def _can_mark(type_text: str) -> bool:
    if contract_type(type_text) in ("json", "xml"):
        return False
    try:
        return is_orderable(spark_type(type_text))
    except Exception:  # a type Spark cannot name is not usable as a mark
        return False


def parents_of(contract: Contract, contracts: list[Contract]) -> list[Contract]:
    """The contracts a table refers to, itself left out.

    A reference names its schema or means the table's own; where none of that schema is known, a
    table of that name in another schema is meant if there is just one.
    """
    found = []
    for _, fk in contract.foreign_keys:
        named = [c for c in contracts if c.table == fk.table]
        same = [c for c in named if c.schema == (fk.schema or contract.schema)]
        for parent in same or (named if len(named) == 1 else []):
            if parent.key != contract.key and parent not in found:
                found.append(parent)
    return found


def labels_of(contracts: list[Contract]) -> list[str]:
    """Table names, with the schema where two tables share one."""
    names = [c.table for c in contracts]
    return [c.table if names.count(c.table) == 1 else f"{c.schema or ''}.{c.table}"
            for c in contracts]


def in_parent_order(contracts: list[Contract]) -> list[Contract]:
    """Parents before children; a cycle leaves the given order untouched."""
    above = {c.key: [p.key for p in parents_of(c, contracts)] for c in contracts}
    left = list(contracts)
    place: dict[tuple[str | None, str], int] = {}
    ordered = []
    while left:
        ready = [c for c in left if all(p in place for p in above[c.key])]
        if not ready:
            return list(contracts)
        # Children follow in the order their last parents came.
        ready.sort(key=lambda c: max((place[p] for p in above[c.key]), default=-1))
        for contract in ready:
            place[contract.key] = len(place)
        ordered += ready
        left = [c for c in left if c.key not in place]
    return ordered


def read_contract(path: str | Path) -> Contract | None:
    """Contract in a YAML file; None where the file is missing or names no table."""
    raw = _read_yaml(Path(path))
    return Contract.from_dict(raw) if raw.get("table") else None


def read_manifest(project: str | Path, with_columns: bool = False) -> list[Contract]:
    """Contracts ``main.yml`` lists, in its order; without it, ``schemas/*.yml`` by name."""
    project = Path(project)
    manifest = project / "main.yml"
    if manifest.exists():
        paths = [
            project / item["path"] for item in _read_yaml(manifest).get("tables") or ()
            if isinstance(item, dict) and item.get("path")
        ]
    else:
        paths = sorted((project / "schemas").glob("*.yml"))
    found = [contract for contract in map(read_contract, paths) if contract]
    return [c for c in found if c.columns] if with_columns else found


def write_contract(contract: Contract, path: str | Path) -> None:
    """YAML file for a contract; keys of an existing file that we do not know are kept."""
    path = Path(path)
    raw = {**_read_yaml(path), **contract.to_dict()}
    path.parent.mkdir(parents=True, exist_ok=True)
    _write_yaml(raw, path)


def _write_yaml(raw: dict[str, Any], path: Path) -> None:
    import yaml

    path.write_text(yaml.safe_dump(raw, allow_unicode=True, sort_keys=False), encoding="utf-8")


def _read_yaml(path: Path) -> dict[str, Any]:
    import yaml

    if not path.exists():
        return {}
    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}
