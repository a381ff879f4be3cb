"""Table loads: full or incremental, one table or a set with parents first."""

from __future__ import annotations

import time
import warnings
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from haulframe.contract import Contract, LoadSpec, in_parent_order, labels_of, parents_of
from haulframe.functions.clean import clean, nested_columns
from haulframe.functions.names import col
from haulframe.operators.checks import require, table_violations
from haulframe.operators.conform import conform
from haulframe.operators.watermark import above, high_water_mark, mark_literal, mark_type
from haulframe.plans.ledger import RunLedger
from haulframe.sources.storage import stage
from haulframe.sources.tables import Table

REPORT = "table string, kind string, rows long, watermark string"


@dataclass(frozen=True)
class Decision:
    """What a load spec asks for."""

    kind: str
    empties: bool
    reads_mark: bool


def decide(spec: LoadSpec) -> Decision:
    """Full loads and ``truncate`` empty the target; only an incremental load that keeps it and
    has a mark column asks for the target's mark. (After emptying there is no mark to find.)"""
    whole = spec.mode == "full" or spec.full_load
    empties = whole or spec.truncate
    return Decision(
        kind="full" if whole or not spec.incremental_column else "incremental",
        empties=empties,
        reads_mark=not empties and spec.incremental_column is not None,
    )


@dataclass(frozen=True)
class LoadOptions:
    """``nested``: arrays, maps and structs become JSON text, or ``"keep"``.
    ``conform``: shape rows to the contract. ``enforce``: check the contract before writing;
    by default for targets that enforce keys themselves.
    ``compact``: even out the files of an incremental append."""

    clean: bool = True
    nested: str = "json"
    conform: bool = False
    enforce: bool | None = None
    compact: bool = True


@dataclass(frozen=True)
class LoadResult:
    table: str
    kind: str
    rows: int
    watermark: str | None = None
    seconds: float = 0.0
    # True where an earlier attempt of the same run had loaded the table.
    resumed: bool = False


def incremental_delta(source: Table | DataFrame, target: Table, column: str) -> DataFrame:
    """Source rows above the target's mark; all rows while the target has none."""
    whole = _rows_of(source)
    held = target.held()
    if held is not None:
        require_like_marks(whole.schema, held.schema, column)
    mark = target.high_water_mark(column, held)
    return whole if mark is None else _above(source, whole, column, mark)


def _rows_of(source: Table | DataFrame) -> DataFrame:
    return source if isinstance(source, DataFrame) else source.read()


def _above(source: Table | DataFrame, whole: DataFrame, column: str, mark: str) -> DataFrame:
    if isinstance(source, DataFrame):
        return above(whole, column, mark)
    return source.read_above(column, mark, whole)


def in_mark_order(delta: DataFrame, column: str, compact: bool = True) -> DataFrame:
    """Delta rows sorted by mark within each task, so the files written have tight statistics.

    A delta is a thin slice of every source split; dealing it out by ranges of the mark turns
    many tiny files into a few whose ranges do not overlap, at the price of shuffling the delta
    only (and of reading it twice, for the ranges). Ties that pile up on one mark value are
    spread by a hash of the row, which a repeated task finds again whatever the order its rows
    come in.
    """
    if compact:
        nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)  # a map has no hash
        plain = [F.to_json(F.struct(col(f.name))) if isinstance(f.dataType, nested)
                 else col(f.name) for f in delta.schema]
        delta = (delta.withColumn("__tie", F.xxhash64(*plain))
                 .repartitionByRange(col(column), F.col("__tie"))
                 .sortWithinPartitions(col(column)).drop("__tie"))
        return delta
    return delta.sortWithinPartitions(col(column))


def require_like_marks(source: T.StructType, target: T.StructType, column: str) -> None:
    """Refuse marks that order unlike each other: the text '9' is above the text '10'."""
    if column not in target.names:
        raise ValueError(f"the target has no column {column!r} to read a mark from")
    kinds = [_mark_kind(s[column].dataType) for s in (source, target)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"column {column!r} is {source[column].dataType.simpleString()} in the "
                         f"source and {target[column].dataType.simpleString()} in the target")


def _mark_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return data_type.typeName()


def missed_rows(source: DataFrame, target: DataFrame, keys: list[str],
                mark_column: str | None = None) -> DataFrame:
    """Source rows the target lacks: ties at the mark, NULL marks and late arrivals, which no
    later incremental load will pick up.

    Keys match null-safely. With ``mark_column``, rows above the target's mark are left out: the
    next load brings them. Only the source's keys at or below the mark are compared, and whole
    rows are read for the missing keys alone.
    """
    if mark_column:
        mark = high_water_mark(target, mark_column)
        if mark is None:
            return source.limit(0)
        old = col(mark_column) <= mark_literal(mark, mark_type(source, mark_column))
        source = source.where(old | col(mark_column).isNull())
    names = [f"__held_{i}" for i in range(len(keys))]
    held = target.select(*[col(k).alias(n) for k, n in zip(keys, names)]).distinct()
    wanted = source.select(*[col(k).alias(f"__want_{i}") for i, k in enumerate(keys)]).distinct()
    absent = stage(wanted.join(held, [F.col(f"__want_{i}").eqNullSafe(F.col(n))
                                      for i, n in enumerate(names)], "left_anti"), "missed")
    same = [col(k).eqNullSafe(F.col(f"__want_{i}")) for i, k in enumerate(keys)]
    picked = F.broadcast(absent.df) if absent.broadcastable else absent.df
    return source.join(picked, same, "left_semi")


def load_table(source: Table | DataFrame, target: Table, contract: Contract | None = None,
               spec: LoadSpec | None = None, options: LoadOptions = LoadOptions(),
               parents: dict[str, DataFrame] | None = None, name: str | None = None) -> LoadResult:
    """Run one load. The load spec comes from ``spec`` or the contract."""
    started = time.monotonic()
    spec = spec or (contract.load if contract else LoadSpec())
    name = name or (contract.table if contract else "table")
    decision = decide(spec)
    column = spec.incremental_column

    # A source without columns must never empty a target. A database is asked for its columns
    # alone: which rows to read, and their bounds, is known after the mark.
    again = isinstance(source, DataFrame) or source.rereadable
    layout = source.schema if isinstance(source, DataFrame) else source.columns()
    if not layout.names:
        return LoadResult(name, decision.kind, 0)

    target.recover()
    held = target.held()
    mark = None
    if decision.reads_mark:
        mark_type(spark_frame(source, layout), column)
        if held is not None:
            require_like_marks(layout, held.schema, column)
            mark = target.high_water_mark(column, held)
    elif not decision.empties:
        warnings.warn(f"{name}: incremental without a mark column appends every row",
                      stacklevel=2)
    if mark is None:
        rows = _rows_of(source)
    elif isinstance(source, DataFrame):
        rows = above(source, column, mark)
    else:
        rows = source.read_above(column, mark)

    schema = target.target_schema(held)
    rows, checked = shaped(rows, schema, contract, options, name, target.enforces_keys, again)
    if checked:
        require(table_violations(rows, contract, parents, None if decision.empties else held))
    if mark is not None and not target.partitioned:
        rows = in_mark_order(rows, column, options.compact and (again or checked))

    write = target.replace if decision.empties else target.append
    written = write(rows, column if column in rows.columns else None, schema)
    return LoadResult(name, decision.kind, written.rows, written.mark or mark,
                      time.monotonic() - started)


def spark_frame(source: Table | DataFrame, layout: T.StructType) -> DataFrame:
    """A frame with the source's columns; no rows are read."""
    if isinstance(source, DataFrame):
        return source
    return source.spark.createDataFrame([], layout)


def shaped(rows: DataFrame, schema: T.StructType | None, contract: Contract | None,
           options: LoadOptions, name: str, enforces_keys: bool,
           rereadable: bool) -> tuple[DataFrame, bool]:
    """Rows as the options ask for, and whether they are to be checked before the write.

    What is checked is staged, so that the rows that were checked are those written, and a
    source that cannot be read twice is asked once.
    """
    if options.clean:
        rows = clean(rows, options.nested, nested_columns(schema))
    if options.conform:
        if not contract or not contract.columns:
            raise ValueError(f"{name}: conforming needs a contract with columns")
        rows = conform(rows, contract)
    wanted = enforces_keys if options.enforce is None else options.enforce
    checked = bool(wanted and contract and contract.columns)
    if checked and not rereadable:
        rows = stage(rows, name).df
    return rows, checked


class LoadError(RuntimeError):
    """Some tables failed. ``results`` are the loads that succeeded, ``errors`` the reasons;
    ``skipped`` tables had a failed parent."""

    def __init__(self, results: list[LoadResult], errors: dict[str, Exception],
                 skipped: list[str]):
        self.results, self.errors, self.skipped = results, errors, skipped
        text = "; ".join(f"{t}: {str(e).splitlines()[0]}" for t, e in errors.items())
        super().__init__(f"{len(errors)} table(s) failed ({text}); skipped: {skipped}")


def load_all(spark: SparkSession, contracts: list[Contract], source, target,
             options: LoadOptions = LoadOptions(), at_once: int = 4,
             ledger: RunLedger | None = None) -> list[LoadResult]:
    """Load every table, each one once its parents are in.

    ``source`` and ``target`` map a contract to its table (or frame). Up to ``at_once`` tables
    run side by side as Spark jobs. When a table fails its children are skipped, the rest still
    loads, and ``LoadError`` tells all. Tables in a reference cycle run in the given order.

    With a ``ledger``, what an earlier attempt of its run finished is not loaded again: those
    results come back as ``resumed``, and only failed, skipped and unknown tables run.
    """
    ordered = in_parent_order(contracts)
    labels = dict(zip([c.key for c in ordered], labels_of(ordered), strict=True))
    if len(labels) < len(ordered):
        raise ValueError("two contracts of one schema name the same table")
    parents = {c.key: [p.key for p in parents_of(c, contracts)] for c in ordered}
    place = {c.key: i for i, c in enumerate(ordered)}
    if any(place[p] > place[key] for key, above_it in parents.items() for p in above_it):
        at_once = 1
    jobs: dict[tuple[str | None, str], Future] = {}
    finished = ledger.all_finished() if ledger else lambda contract: None

    def run(contract: Contract) -> LoadResult | None:
        # Parents were submitted before, so waiting for them cannot block them.
        if any(jobs[p].exception() or jobs[p].result() is None
               for p in parents[contract.key] if place[p] < place[contract.key]):
            return None
        # Under the FAIR scheduler each table gets its share of the executors.
        label = labels[contract.key]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", label)
        into = target(contract)
        noted = finished(contract)
        if noted and into.exists():
            return LoadResult(label, noted["kind"], noted["rows"], noted["watermark"],
                              noted["seconds"], resumed=True)
        wanted = into.enforces_keys if options.enforce is None else options.enforce
        frames = _parent_frames(contract, contracts, target) if wanted else None
        result = load_table(source(contract), into, contract, options=options, parents=frames,
                            name=label)
        if ledger:
            ledger.note(contract, label, result.kind, result.rows, result.watermark,
                        result.seconds)
        return result

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        for contract in ordered:
            jobs[contract.key] = pool.submit(inheritable_thread_target(spark)(run), contract)
    errors = {labels[k]: job.exception() for k, job in jobs.items() if job.exception()}
    good = {labels[k]: job.result() for k, job in jobs.items() if not job.exception()}
    done = [result for result in good.values() if result]
    if errors:
        raise LoadError(done, errors, [label for label, result in good.items() if not result])
    return done


def _parent_frames(contract: Contract, contracts: list[Contract], target) -> dict[str, DataFrame]:
    tables = {p.table: target(p) for p in parents_of(contract, contracts)}
    return {p: t.read() for p, t in tables.items() if t.exists()}


def load_report(spark: SparkSession, results: list[LoadResult]) -> DataFrame:
    """``(table, kind, rows, watermark)`` per load."""
    return spark.createDataFrame(
        [(r.table, r.kind, r.rows, r.watermark) for r in results], REPORT)
