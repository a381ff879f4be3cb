"""A project folder: connections in ``.env``, contracts in ``main.yml`` and ``schemas/``."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from haulframe.contract import (
    Contract,
    LoadSpec,
    _read_yaml,
    _write_yaml,
    labels_of,
    read_manifest,
    write_contract,
)
from haulframe.plans.load import LoadOptions, LoadResult, load_all, load_table
from haulframe.plans.target import ensure_target
from haulframe.sources.connection import BATCH_ROWS, Connection
from haulframe.sources.listing import describe_missing
from haulframe.sources.tables import TASKS, Table, open_table

# Variable prefixes of the two ends in a project's .env.
SOURCE_PREFIX = "DB_ORIGEM"
TARGET_PREFIX = "DB_DESTINO"


def read_env(path: str | Path) -> dict[str, str]:
    """``KEY=value`` lines; blank lines and ``#`` comments are skipped."""
    values = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, sign, value = line.strip().partition("=")
        if sign and not key.startswith("#"):
            values[key.strip()] = value.strip()
    return values


@dataclass
class Project:
    spark: SparkSession
    folder: Path
    source: Connection
    target: Connection
    contracts: list[Contract]
    read_tasks: int = TASKS
    write_tasks: int | None = TASKS

    @classmethod
    def open(cls, spark: SparkSession, folder: str | Path, batch_rows: int = BATCH_ROWS,
             read_tasks: int = TASKS, write_tasks: int | None = TASKS) -> "Project":
        """``read_tasks`` and ``write_tasks`` bound the connections to a database; None writes
        with as many as the rows come in."""
        folder = Path(folder)
        values = read_env(folder / ".env")
        return cls(
            spark, folder,
            Connection.from_env(values, SOURCE_PREFIX, batch_rows=batch_rows),
            Connection.from_env(values, TARGET_PREFIX, batch_rows=batch_rows),
            read_manifest(folder), read_tasks, write_tasks,
        )

    def source_table(self, contract: Contract) -> Table:
        options = {} if self.source.is_lake else {"partitions": self.read_tasks}
        return open_table(self.spark, self.source, contract.table, contract, source=True,
                          **options)

    def target_table(self, contract: Contract) -> Table:
        options = {} if self.target.is_lake else {"write_tasks": self.write_tasks}
        return open_table(self.spark, self.target, contract.table, contract, **options)

    def load(self, table: str, options: LoadOptions = LoadOptions()) -> LoadResult:
        named = dict(zip(labels_of(self.contracts), self.contracts, strict=True))
        contract = named.get(table)
        if contract is None:
            raise KeyError(f"{table!r} is not in the project")
        return load_table(self.source_table(contract), self.target_table(contract), contract,
                          options=options)

    def load_all(self, options: LoadOptions = LoadOptions()) -> list[LoadResult]:
        return load_all(self.spark, self.contracts, self.source_table, self.target_table, options)

    def create_targets(self) -> dict[str, bool]:
        """Create the missing target tables of contracts that have columns."""
        return {label: ensure_target(self.spark, self.target_table(c), c)
                for label, c in zip(labels_of(self.contracts), self.contracts) if c.columns}

    def describe(self, table: str | None = None) -> list[str]:
        """Fill in missing columns from the source and write the contracts back."""
        before = {c.key: c for c in self.contracts}
        if table and table not in labels_of(self.contracts):
            self.contracts.append(Contract(table))
        self.contracts = describe_missing(self.spark, self.source, self.contracts, table)
        changed = [c for c in self.contracts if before.get(c.key) != c and c.columns]
        for contract in changed:
            write_contract(contract, self._path(contract))
            self._register(contract)
        return [c.table for c in changed]

    def complete_schedules(self) -> None:
        """Fill the load keys the user left out and write the contracts back."""
        completed = []
        for contract in self.contracts:
            if contract.columns:
                given = _read_yaml(self._path(contract)).get("schedule")
                contract = contract.with_load(LoadSpec.complete(given, list(contract.columns)))
                write_contract(contract, self._path(contract))
            completed.append(contract)
        self.contracts = completed

    def _register(self, contract: Contract) -> None:
        """Name a contract's file in ``main.yml``, where there is one that does not yet."""
        manifest = self.folder / "main.yml"
        raw = _read_yaml(manifest)
        path = self._path(contract).relative_to(self.folder).as_posix()
        listed = raw.get("tables") or []
        if manifest.exists() and all(
                not isinstance(t, dict) or t.get("path") != path for t in listed):
            _write_yaml({**raw, "tables": [*listed, {"path": path}]}, manifest)

    def _path(self, contract: Contract) -> Path:
        shared = sum(c.table == contract.table for c in self.contracts) > 1
        name = f"{contract.schema}.{contract.table}" if shared else contract.table
        return self.folder / "schemas" / f"{name}.yml"
