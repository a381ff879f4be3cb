"""Tables a load reads from and writes to: folders, databases and catalog tables."""

from __future__ import annotations

import uuid
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from haulframe.contract import Contract
from haulframe.functions.defaults import default_column
from haulframe.functions.names import col, quoted
from haulframe.operators.conform import align, match_names
from haulframe.operators.watermark import (
    above,
    from_mark,
    high_water_mark,
    mark_type,
    max_text,
)
from haulframe.sources.connection import LAKES, Connection
from haulframe.sources.curve import along_curve
from haulframe.sources.metadata import Facts, read_facts, session
from haulframe.sources.splits import split_points, split_predicates
from haulframe.sources.storage import Storage, scratch_path, stage

# Connections a load opens to a database, reading or writing, unless told otherwise.
TASKS = 16
# Files renamed at the same time when an append moves in.
RENAMES_AT_ONCE = 16
# Prefix of the table properties that hold defaults to fill in at load time, by the place of
# their column. (Spark hides properties whose text looks like a secret, as a name may.)
GENERATED = "haulframe.generated."
# Marker of a folder whose rows are complete.
READY = "_READY"
# Columns of a load's own database table: a row's place in the files the load wrote before.
PLACE = ("hf_file", "hf_row")


@dataclass(frozen=True)
class Written:
    """What one write did, counted by the write itself."""

    rows: int
    mark: str | None = None


class Table:
    """Common part: count and mark of the written rows come from the write's own pass."""

    spark: SparkSession
    enforces_keys = False
    # False where reading twice is costly or may give other rows.
    rereadable = True
    # True where writes are distributed by the table's own partitioning.
    partitioned = False

    def exists(self) -> bool:
        raise NotImplementedError

    def read(self) -> DataFrame:
        raise NotImplementedError

    def read_above(self, column: str, mark: str, whole: DataFrame | None = None) -> DataFrame:
        """Rows strictly above a mark; ``whole`` is the table if it was read already."""
        return above(self.read() if whole is None else whole, column, mark)

    def columns(self) -> T.StructType:
        """Live schema; no rows are read."""
        return self.read().schema

    def recover(self) -> None:
        """Finish or undo what a stopped writer left. Called before a load, by its one writer."""

    def held(self) -> DataFrame | None:
        """Present content; None where the table is missing."""
        return self.read() if self.exists() else None

    def high_water_mark(self, column: str, held: DataFrame | None = None) -> str | None:
        """MAX of a column; None where the table is missing or empty. ``held`` is the table if
        it was read already."""
        held = self.held() if held is None else held
        return None if held is None else high_water_mark(held, column)

    def append(self, df: DataFrame, mark_column: str | None = None,
               schema: T.StructType | None = None) -> Written:
        """Add rows, columns matched by name. ``schema`` saves looking up the target's."""
        self.recover()
        return self._observed(self._aligned(df, schema), mark_column, self._append)

    def replace(self, df: DataFrame, mark_column: str | None = None,
                schema: T.StructType | None = None) -> Written:
        """Make ``df`` the whole content."""
        self.recover()
        return self._observed(self._aligned(df, schema), mark_column, self._replace)

    def target_schema(self, held: DataFrame | None = None) -> T.StructType | None:
        """Schema rows must take: the declared one or the live one, if any."""
        held = self.held() if held is None else held
        return None if held is None else held.schema

    def _aligned(self, df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
        schema = schema or self.target_schema()
        return df if schema is None else align(df, schema, self._defaults())

    def truncate(self) -> None:
        """Empty the table and keep its columns."""
        raise NotImplementedError

    def _defaults(self) -> dict[str, Column]:
        return {}

    def _laid_out(self, df: DataFrame) -> DataFrame:
        """Hook: distribute and sort rows before a write."""
        return df

    def _observed(self, df: DataFrame, mark_column: str | None, write) -> Written:
        metrics = Observation()
        wanted = [F.count(F.lit(1)).alias("rows")]
        if mark_column:
            wanted.append(max_text(mark_column, mark_type(df, mark_column)).alias("mark"))
        # Last step before the write: in a final stage a retried task is counted once.
        write(self._laid_out(df).observe(metrics, *wanted))
        found = metrics.get
        self._commit(found["rows"])
        return Written(found["rows"], found.get("mark"))

    def _commit(self, rows: int) -> None:
        """Hook: make what was just written part of the table."""

    def _append(self, df: DataFrame) -> None:
        raise NotImplementedError

    def _replace(self, df: DataFrame) -> None:
        raise NotImplementedError


class PathTable(Table):
    """A folder of Parquet (or any Spark file format), or a Delta table by path."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet",
                 contract: Contract | None = None, schema: T.StructType | None = None,
                 partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (),
                 direct_append: bool = False, rebalance: bool = True,
                 cluster_by: tuple[str, ...] = (), cluster_files: int | None = None):
        """``cluster_by`` lays each write out along a curve through those columns, so that files
        prune by any of them; ``cluster_files`` is the number of its ranges. ``direct_append`` leaves appends to the file system's own committer, for object
        stores where a rename is a copy and the committer is atomic already. ``rebalance=False``
        saves the shuffle of a partitioned write whose source is laid out alike."""
        self.spark = spark
        self.rebalance = rebalance
        self.direct_append = direct_append
        self.path = path.rstrip("/")
        self.format = fmt
        self.contract = contract
        self.schema = schema
        if contract and contract.columns and schema is None:
            self.schema = contract.to_struct()
        self.partition_by = tuple(partition_by or (contract.partition_by if contract else ()))
        self.sort_by = tuple(sort_by or (contract.order_by if contract else ()))
        if self.partition_by and self.schema is None and fmt != "delta":
            # Folder names alone do not tell a partition column's type.
            raise ValueError("a partitioned folder needs a contract or a schema")
        self.cluster_by, self.cluster_files = tuple(cluster_by), cluster_files
        layout = (*self.partition_by, *self.sort_by, *self.cluster_by)
        unknown = [c for c in layout if self.schema is not None and c not in self.schema.names]
        if unknown:
            raise ValueError(f"layout needs plain column names, not {unknown}")
        self.partitioned = bool(self.partition_by)
        self._storage = Storage(spark, self.path)

    @property
    def beside(self) -> str:
        """Prefix of hidden working folders next to the table."""
        parent, slash, name = self.path.rpartition("/")
        return f"{parent}{slash}.{name}"

    def exists(self) -> bool:
        """True for a folder that holds a table; a bare folder tells no columns."""
        if self.schema is not None or self.format == "delta":
            return self._storage.exists(self.path)
        return self._storage.has_files(self.path)

    def target_schema(self, held: DataFrame | None = None) -> T.StructType | None:
        if self.schema is not None and not (self.format == "delta" and self.exists()):
            return _nullable(self.schema)
        return super().target_schema(held)

    def read(self) -> DataFrame:
        reader = self.spark.read.format(self.format)
        if self.schema is not None and self.format != "delta":
            df = reader.schema(_nullable(self.schema)).load(self.path)
            return df.select(*[col(n) for n in self.schema.names])
        return reader.load(self.path)

    def high_water_mark(self, column: str, held: DataFrame | None = None) -> str | None:
        """MAX of a column.

        The last write left its mark beside the table. The search only opens row groups whose
        statistics reach that value; if none does, the rows have changed since, and all are
        searched. The answer is the same.
        """
        df = self.held() if held is None else held
        if df is None:
            return None
        mark_type(df, column)
        floor = self._noted(column) if self.format != "delta" else None
        found = None if floor is None else high_water_mark(from_mark(df, column, floor), column)
        return high_water_mark(df, column) if found is None else found

    @property
    def _notes(self) -> str:
        return f"{self.beside}.marks"

    def _noted(self, column: str) -> str | None:
        """Mark the last write left; None where there is no usable note."""
        if not self._storage.exists(self._notes):
            return None
        prefix = quote(column, safe="") + "="
        noted = [n for n in self._storage.list(self._notes) if n.startswith(prefix)]
        return unquote(noted[0][len(prefix):]) if len(noted) == 1 else None

    def _note(self, column: str, mark: str) -> None:
        name = f"{quote(column, safe='')}={quote(mark, safe='')}"
        if self.format == "delta" or len(name) > 200:
            return
        self._storage.delete(self._notes)
        self._storage.make_dir(self._notes)
        self._storage.create_empty(f"{self._notes}/{name}")

    def _observed(self, df: DataFrame, mark_column: str | None, write) -> Written:
        written = super()._observed(df, mark_column, write)
        if mark_column and written.mark is not None:
            self._note(mark_column, written.mark)
        return written

    def truncate(self) -> None:
        df = self.read()
        if self.format == "delta":
            self._write(df.limit(0), self.path, "overwrite")
        else:
            self._swap_in(df.limit(0))

    def create(self) -> bool:
        """Write an empty table from the contract unless one is there. True if created."""
        if self.exists():
            return False
        if self.schema is None:
            raise ValueError("creating a folder table needs a contract or a schema")
        self._write(self.spark.createDataFrame([], _nullable(self.schema)), self.path, "append")
        if not self._storage.exists(self.path):
            self._storage.make_dir(self.path)
        return True

    def _defaults(self) -> dict[str, Column]:
        if not self.contract:
            return {}
        return {c.name: default_column(c.default, c.spark_type)
                for c in self.contract.columns if c.has_default}

    def _laid_out(self, df: DataFrame) -> DataFrame:
        if self.cluster_by:
            return along_curve(df, self.cluster_by, self.cluster_files, self.partition_by)
        if self.partition_by and self.rebalance:
            # Rebalance rather than repartition: a partition value that holds a large share of
            # the rows is split over several tasks at run time.
            df = df.hint("rebalance", *[col(c) for c in self.partition_by])
        order = [*self.partition_by, *(c for c in self.sort_by if c not in self.partition_by)]
        return df.sortWithinPartitions(*[col(c) for c in order]) if order else df

    def _write(self, df: DataFrame, path: str, mode: str) -> None:
        writer = df.write.format(self.format).mode(mode)
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.save(path)

    def _append(self, df: DataFrame) -> None:
        if self.format == "delta" or self.direct_append:
            self._write(df, self.path, "append")
        elif not self.exists():
            self._swap_in(df)
        else:
            self._stage(df, self._appending)

    def _commit(self, rows: int) -> None:
        if not self._is_ready(self._appending):
            return
        if rows == 0 and self._is_empty(self._appending):
            # Nothing new: do not leave an empty file behind on every run.
            self._storage.delete(self._appending)
        else:
            self._move_in(self._appending)

    def _is_empty(self, folder: str) -> bool:
        schema = _nullable(self.read().schema)
        return self.spark.read.format(self.format).schema(schema).load(folder).isEmpty()

    def _replace(self, df: DataFrame) -> None:
        if self.format == "delta":
            self._write(df, self.path, "overwrite")  # one transaction
        else:
            self._swap_in(df)

    # Plain folders have no transactions. A failed overwrite deletes the old files; an append
    # that stops while committing leaves some new files, and with them a mark above rows that
    # never arrived. So rows are written beside the table, marked ready, and only then renamed
    # into place; a later load finishes the renames or throws an unready folder away.

    @property
    def _appending(self) -> str:
        return f"{self.beside}.append"

    def _stage(self, df: DataFrame, folder: str) -> None:
        self._write(df, folder, "overwrite")
        self._storage.make_dir(folder)  # a partitioned write of no rows leaves no folder
        self._storage.create_empty(f"{folder}/{READY}")

    def _is_ready(self, folder: str) -> bool:
        return self._storage.exists(f"{folder}/{READY}")

    def _move_in(self, folder: str) -> None:
        """Rename staged files into the table. File names are unique, so this can resume."""
        names = [n for n in self._storage.files(folder)
                 if not n.rsplit("/", 1)[-1].startswith(("_", "."))]
        for below in {n.rpartition("/")[0] for n in names}:
            self._storage.make_dir(f"{self.path}/{below}".rstrip("/"))
        with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
            list(pool.map(
                lambda n: self._storage.rename(f"{folder}/{n}", f"{self.path}/{n}"), names))
        self._storage.delete(folder)

    def _swap_in(self, df: DataFrame) -> None:
        staged, previous = f"{self.beside}.staged", f"{self.beside}.previous"
        self._write(df, staged, "overwrite")
        self._storage.make_dir(staged)
        if self._storage.exists(self.path):
            self._storage.delete(previous)
            self._storage.rename(self.path, previous)
        self._storage.rename(staged, self.path)
        self._storage.delete(previous)

    def recover(self) -> None:
        if self.format == "delta":
            return
        previous = f"{self.beside}.previous"
        if not self._storage.exists(self.path) and self._storage.exists(previous):
            self._storage.rename(previous, self.path)
        if self._is_ready(self._appending):
            self._move_in(self._appending)

    def append_batch(self, df: DataFrame, batch: str) -> Written:
        """Append a batch exactly once, however often it is replayed.

        ``batch`` is a stream's name, a hyphen and a number that grows from batch to batch. The
        ledger keeps one file for each stream: the number of its last batch.
        """
        if self.format == "delta":
            # Delta remembers an application's last version and skips what it has seen.
            name, _, version = batch.rpartition("-")
            return self._observed(self._aligned(df), None, lambda out: (
                out.write.format("delta").mode("append").option("txnAppId", name or "batches")
                .option("txnVersion", version).save(self.path)))
        stream, _, number = batch.rpartition("-")
        ledger, staged = f"{self.beside}.batches/{stream}", f"{self.beside}.batch-{batch}"
        known = self._storage.list(ledger) if self._storage.is_dir(ledger) else []
        last = max(map(int, known), default=-1)
        if int(number) <= last:
            return Written(0)
        written = Written(0)
        if not self._is_ready(staged):
            written = self._observed(self._aligned(df), None,
                                     lambda out: self._stage(out, staged))
        self._storage.make_dir(self.path)
        self._move_in(staged)
        self._storage.create_empty(f"{ledger}/{number}")
        for old in known:
            self._storage.delete(f"{ledger}/{old}")
        return written


class JdbcTable(Table):
    """A table in a database, read and written by parallel tasks.

    Each task commits its own rows. If an executor is lost right after a commit, the repeated
    task inserts them again: a primary key refuses that, and ``verify`` finds it by comparing the
    table's count before and after with the rows sent.

    Reads come in ``partitions`` tasks: by ranges of ``partition_column``, or, with ``hashed``,
    by buckets of a hash of it, which suits any type and any spread of values. Ranges are of
    equal width; with ``equal_depth`` they hold about as many rows each, for the price of reading
    that column once before. Writes open
    ``write_tasks`` connections; None leaves the rows in the tasks they come in.
    """

    # With ``atomic`` a load is one transaction. Its tasks fill a table of its own, each row with
    # its place in files written before, so rows that a repeated task inserts again are copies of
    # the first; then one INSERT ... SELECT DISTINCT moves them, after a DELETE in the same
    # transaction where the load replaces. Readers see all rows of a load or none, a failed load
    # leaves the table as it was, and verifying is not needed.

    rereadable = False

    def __init__(self, spark: SparkSession, connection: Connection, table: str,
                 schema: str | None = None, partition_column: str | None = None,
                 partitions: int = 1, write_tasks: int | None = TASKS, hashed: bool = False,
                 column_types: str | None = None, create_options: str | None = None,
                 verify: bool = False, equal_depth: bool = False, atomic: bool = False):
        self.spark = spark
        self.verify = verify
        self.atomic = atomic
        self.equal_depth = equal_depth
        self.create_options = create_options
        self.connection = connection
        self.name = table
        self.schema = schema or connection.default_schema
        self.partition_column = partition_column
        self.partitions = partitions
        self.write_tasks = write_tasks
        self.hashed = hashed
        self.column_types = column_types

    @property
    def enforces_keys(self) -> bool:  # type: ignore[override]
        return self.connection.dialect.enforces_keys

    @property
    def _dbtable(self) -> str:
        return self.connection.qualified(self.name, self.schema)

    @property
    def _in_catalog(self) -> str:
        parts = [self.connection.catalog(self.spark), self.schema, self.name]
        return ".".join(quoted(p) for p in parts if p)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self._in_catalog)

    def read(self) -> DataFrame:
        return self._load(None)

    def read_above(self, column: str, mark: str, whole: DataFrame | None = None) -> DataFrame:
        if whole is None or self._parallel:
            # The ranges to read in parallel are those of the new rows only.
            whole = self._load((column, mark))
        return above(whole, column, mark)

    @property
    def _parallel(self) -> bool:
        return self.partition_column is not None and self.partitions > 1

    def _load(self, above_mark: tuple[str, str] | None) -> DataFrame:
        options = self.connection.jdbc_options()
        buckets = None
        if self._parallel and self.hashed:
            buckets = self.connection.bucket_predicates(self.partition_column, self.partitions)
        if buckets:
            return self.spark.read.jdbc(options.pop("url"), self._dbtable, predicates=buckets,
                                        properties=options)
        reader = self.spark.read.format("jdbc").options(**self.connection.jdbc_options())
        reader = reader.option("dbtable", self._dbtable)
        bounds = self._bounds(above_mark) if self._parallel and not self.hashed else None
        if bounds and self.equal_depth:
            key = self.partition_column
            keys = self._in_ranges(reader, bounds).select(col(key))
            if above_mark and key == above_mark[0]:
                keys = above(keys, *above_mark)
            points = split_points(keys, key, self.partitions)
            return self.spark.read.jdbc(
                options.pop("url"), self._dbtable, properties=options,
                predicates=split_predicates(self.connection.quoted(key), points,
                                            keys.schema[key].dataType))
        if bounds:
            return self._in_ranges(reader, bounds)
        return reader.load()

    def _in_ranges(self, reader, bounds: tuple[str, str]) -> DataFrame:
        return reader.options(
            partitionColumn=self.partition_column, lowerBound=bounds[0], upperBound=bounds[1],
            numPartitions=str(self.partitions)).load()

    def _bounds(self, above_mark: tuple[str, str] | None) -> tuple[str, str] | None:
        """MIN and MAX of the partition column among the rows to read, found by the database."""
        df = self.spark.table(self._in_catalog)
        if above_mark:
            df = above(df, *above_mark)
        key = col(self.partition_column)
        low, high = df.agg(F.min(key).cast("string"), F.max(key).cast("string")).first()
        return (low, high) if low is not None and low != high else None

    def columns(self) -> T.StructType:
        return self.spark.table(self._in_catalog).schema

    def high_water_mark(self, column: str, held: DataFrame | None = None) -> str | None:
        """MAX, computed by the database."""
        if not self.exists():
            return None
        return high_water_mark(self.spark.table(self._in_catalog), column)

    def truncate(self) -> None:
        self._replace(self.read().limit(0))

    def _laid_out(self, df: DataFrame) -> DataFrame:
        # As many connections at most, however many tasks the cluster could run. Done here, as
        # the writer's own numPartitions option would lose the observed counts.
        return df.coalesce(self.write_tasks) if self.write_tasks else df

    def _aligned(self, df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
        """Only the columns the source has, in the target's types: the database fills in its own
        defaults for the others."""
        if schema is None:
            schema = self.columns() if self.exists() else None
        if schema is None:
            return df
        found = match_names(df, schema.names)
        return align(df, T.StructType([f for f in schema.fields if f.name in found]))

    def _writer(self, df: DataFrame, mode: str, into: str | None = None):
        writer = df.write.format("jdbc").mode(mode).options(**self.connection.jdbc_options())
        if self.column_types:
            writer = writer.option("createTableColumnTypes", self.column_types)
        if self.create_options and into is None:
            writer = writer.option("createTableOptions", self.create_options)
        return writer.option("dbtable", into or self._dbtable)

    def append(self, df: DataFrame, mark_column: str | None = None,
               schema: T.StructType | None = None) -> Written:
        before = self._count() if self.verify else 0
        written = super().append(df, mark_column, schema)
        return self._verified(written, before)

    def replace(self, df: DataFrame, mark_column: str | None = None,
                schema: T.StructType | None = None) -> Written:
        return self._verified(super().replace(df, mark_column, schema), 0)

    def _count(self) -> int:
        """Rows held, counted by the database."""
        return self.spark.table(self._in_catalog).count() if self.exists() else 0

    def _verified(self, written: Written, before: int) -> Written:
        if self.verify and (now := self._count()) != before + written.rows:
            raise RuntimeError(f"{self.name} holds {now} rows, not {before} + {written.rows}: "
                               "a repeated task may have written twice")
        return written

    def _append(self, df: DataFrame) -> None:
        if self.atomic:
            self._move(df, empty_first=False)
        else:
            self._writer(df, "append").save()

    def _move(self, df: DataFrame, empty_first: bool) -> None:
        """Load the rows in one transaction."""
        path = scratch_path(self.spark, "moving")
        df.write.parquet(path)  # also counts the rows once
        names = df.columns
        rows = self.spark.read.schema(df.schema).parquet(path).select(
            F.xxhash64("_metadata.file_name").alias(PLACE[0]),
            F.col("_metadata.row_index").alias(PLACE[1]), *[col(n) for n in names])
        if not self.exists():
            self._writer(self.spark.createDataFrame([], df.schema), "append").save()
        staging = self.connection.qualified(f"hf_load_{uuid.uuid4().hex[:20]}", self.schema)
        try:
            self._writer(self._laid_out(rows), "append", staging).save()
            self._execute(*move_statements(self.connection, self._dbtable, staging, names,
                                           empty_first))
        finally:
            self._execute_quietly(f"DROP TABLE {staging}")

    def _replace(self, df: DataFrame) -> None:
        if self.atomic:
            self._move(df, empty_first=True)
            return
        # Emptying keeps the table's own column types; a drop would not. Not one transaction.
        if self.exists():
            self._empty(df)
        self._append(df)

    def _empty(self, df: DataFrame) -> None:
        """TRUNCATE, or DELETE where that is refused: a referenced table cannot be truncated."""
        none = self.spark.createDataFrame([], df.schema)
        try:
            self._writer(none, "overwrite").option("truncate", "true").save()
        except (PySparkException, Py4JJavaError):
            self._execute(f"DELETE FROM {self._dbtable}")

    def _execute(self, *statements: str) -> None:
        """Run statements in the database, from the driver; several as one transaction."""
        with session(self.spark, self.connection.jdbc_options()) as opened:
            if len(statements) > 1:
                opened.setAutoCommit(False)
            try:
                for statement in statements:
                    opened.createStatement().executeUpdate(statement)
                if len(statements) > 1:
                    opened.commit()
            except Py4JJavaError:
                if len(statements) > 1:
                    opened.rollback()
                raise

    def _execute_quietly(self, statement: str) -> None:
        """Clean up; a failure here must not hide the load's own."""
        try:
            self._execute(statement)
        except Py4JJavaError as problem:
            warnings.warn(f"{statement}: {problem.java_exception.getMessage()}", stacklevel=2)

    def facts(self) -> Facts:
        """Keys, uniques, references and defaults, from the database's metadata."""
        with session(self.spark, self.connection.jdbc_options()) as opened:
            return read_facts(opened, self.connection.kind, self.name, self.schema)


class CatalogTable(Table):
    """A table of the session catalog; missing columns take the table's DEFAULTs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = name

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _laid_out(self, df: DataFrame) -> DataFrame:
        """A bucket's rows together, but for those of a bucket too large for a task: otherwise
        every task would write a file for every bucket."""
        keys = [c.name for c in self.spark.catalog.listColumns(self.name)
                if c.isBucket] if self.exists() else []
        return df.hint("rebalance", *[col(k) for k in keys]) if keys else df

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, df: DataFrame, mark_column: str | None = None,
               schema: T.StructType | None = None) -> Written:
        return self._observed(self._filled(df), mark_column,
                              lambda out: self._insert(out, "INTO"))

    def replace(self, df: DataFrame, mark_column: str | None = None,
                schema: T.StructType | None = None) -> Written:
        if not self.exists():
            return self._observed(df, mark_column, lambda out: out.write.saveAsTable(self.name))
        # INSERT OVERWRITE deletes before it writes. The rows are staged first, so that a load
        # that fails while they are made leaves the table as it was.
        staged = stage(self._filled(df), "replacing").df
        return self._observed(staged, mark_column, lambda out: self._insert(out, "OVERWRITE"))

    def _filled(self, df: DataFrame) -> DataFrame:
        """Rows with the defaults that a table cannot hold, as its properties name them."""
        if not self.exists():
            return df
        have = {c.lower() for c in df.columns}
        fields = self.read().schema.fields
        for row in self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect():
            if row["key"].startswith(GENERATED):
                field = fields[int(row["key"].removeprefix(GENERATED))]
                if field.name.lower() not in have:
                    df = df.withColumn(field.name, default_column(row["value"], field.dataType))
        return df

    def truncate(self) -> None:
        self.spark.sql(f"TRUNCATE TABLE {self.name}")

    def _insert(self, df: DataFrame, verb: str) -> None:
        if not self.exists():
            df.write.saveAsTable(self.name)
            return
        self.spark.sql(f"INSERT {verb} {self.name} BY NAME SELECT * FROM {{rows}}", rows=df)


def move_statements(connection: Connection, target: str, staging: str, names: list[str],
                    empty_first: bool) -> list[str]:
    """Statements that move a load's rows to their table, each place of a row once."""
    listed = ", ".join(connection.quoted(n) for n in names)
    places = ", ".join(connection.quoted(n) for n in PLACE)
    moved = (f"INSERT INTO {target} ({listed}) SELECT {listed} FROM "
             f"(SELECT DISTINCT {places}, {listed} FROM {staging}) moved")
    return [f"DELETE FROM {target}", moved] if empty_first else [moved]


def open_table(spark: SparkSession, connection: Connection, table: str,
               contract: Contract | None = None, source: bool = False, **options) -> Table:
    """Table of a connection.

    A source keeps its own namespace; a target goes to the contract's. A database source is read
    by ``partitions`` tasks when the contract names a column to split it by.
    """
    if connection.is_lake:
        path = f"{connection.warehouse}/{table}"
        return PathTable(spark, path, LAKES[connection.kind], None if source else contract,
                         **options)
    schema = connection.default_schema
    if not source and contract:
        schema = contract.target_schema(connection.schema or connection.dialect.default_schema
                                        or connection.database)
    if source and contract:
        whole = range_column(contract)
        options.setdefault("partition_column", whole or hash_column(contract))
        options.setdefault("hashed", whole is None)
        options.setdefault("partitions", TASKS)
    return JdbcTable(spark, connection, table, schema, **options)


def range_column(contract: Contract) -> str | None:
    """Column to read a database table in ranges by: the first whole-number column of the primary
    key, else the mark column if it is a whole number, a date or an instant (Spark splits by no
    other types, and reads the bounds of numbers as whole ones)."""
    for name in contract.primary_key:
        if isinstance(contract.column(name).spark_type, T.IntegralType):
            return name
    mark = contract.load.incremental_column
    known = {c.name: c.spark_type for c in contract.columns}
    if isinstance(known.get(mark), (T.IntegralType, T.DateType, T.TimestampType)):
        return mark
    return None


def hash_column(contract: Contract) -> str | None:
    """Column to deal rows into buckets by, where none suits ranges: the first key column, else
    the mark, else the first column. Without any the table comes through one task."""
    names = [*contract.primary_key, contract.load.incremental_column,
             *(c.name for c in contract.columns)]
    return next((n for n in names if n), None)


def _nullable(schema: T.StructType) -> T.StructType:
    """Same fields, all nullable and without contract metadata, as files are read."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
