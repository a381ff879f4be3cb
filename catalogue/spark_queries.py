"""Queries by name: ``(spark, sf_dir) -> DataFrame``. Writes go to fresh scratch folders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

import haulframe as hf
from catalogue.contracts import TABLES, contract, contracts, frame, given
from haulframe.functions.copytext import copy_field
from haulframe.functions.names import col
from haulframe.sources.splits import split_number, split_points
from haulframe.sources.storage import is_local, scratch_path, stage

CUTOFF = "1999-01-01 00:00:00"
EVENT_CUTOFF = "2024-01-15 00:00:00"
RECENT = "1998-01-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def at_or_before(df: DataFrame, column: str, moment: str) -> DataFrame:
    return df.where(col(column) <= F.lit(moment).cast("timestamp_ntz"))


def fresh(spark: SparkSession, table: str, **options) -> hf.PathTable:
    return hf.PathTable(spark, scratch_path(spark, table), **options)


def seeded(spark: SparkSession, table: str, rows: DataFrame) -> hf.PathTable:
    target = fresh(spark, table)
    target.append(rows)
    return target


def incremental(column: str | None, **keys) -> hf.LoadSpec:
    return hf.LoadSpec("incremental", column, **keys)


# -- sources, sinks, projections ---------------------------------------------------------


@query
def scan_table(spark, sf_dir):
    lineitem = frame(spark, sf_dir, "lineitem")
    return lineitem.select(*[col(c) for c in lineitem.columns])


@query
def scan_path_table(spark, sf_dir):
    lake = hf.Connection("parquet", host=sf_dir)
    return hf.open_table(spark, lake, "events.parquet", source=True).read()


@query
def append_path_table(spark, sf_dir):
    target = fresh(spark, "customer")
    target.append(frame(spark, sf_dir, "customer"))
    target.append(frame(spark, sf_dir, "customer"))
    return target.read()


@query
def append_by_name(spark, sf_dir):
    customer = frame(spark, sf_dir, "customer")
    target = seeded(spark, "customer", customer)
    target.append(customer.select(*[col(c) for c in reversed(customer.columns)]))
    return target.read()


@query
def truncate_target(spark, sf_dir):
    target = seeded(spark, "orders", frame(spark, sf_dir, "orders"))
    seeded_rows = target.read().count()
    target.truncate()
    return target.read().agg(F.lit(seeded_rows).cast("long").alias("seeded"),
                             F.count(F.lit(1)).alias("n"),
                             F.lit(len(target.columns())).alias("columns"))


@query
def layout_partitioned(spark, sf_dir):
    layout = contract("orders", partition_by=["o_orderstatus"], order_by=["o_orderdate"])
    target = fresh(spark, "orders", contract=layout)
    target.append(frame(spark, sf_dir, "orders"))
    return target.read()


@query
def layout_clustered(spark, sf_dir):
    """Laid out along a curve through customer and date: a range of either opens few files."""
    target = fresh(spark, "orders", cluster_by=("o_custkey", "o_orderdate"), cluster_files=16)
    target.append(frame(spark, sf_dir, "orders"))
    rows = target.read().withColumn("file", F.col("_metadata.file_path"))
    spans = stage(rows.groupBy("file").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("o_custkey", "o_orderdate")
          for n, f in (("low", F.min), ("high", F.max))]), "spans").df
    middle = rows.agg(*[F.percentile_approx(c, 0.1) for c in ("o_custkey",)]).first()[0]
    opened = spans.agg(F.count_if(F.col("low_o_custkey") <= middle) * 2 <= F.count(F.lit(1))
                       ).first()[0]
    return rows.drop("file").withColumn("few_files", F.lit(opened))


@query
def bucketed_references(spark, sf_dir):
    """Orphans of lineitem in catalog tables bucketed by the order key: no shuffle of rows."""
    namespace = f"hf_{uuid4().hex}"
    hf.create_namespace(spark, namespace, scratch_path(spark, "namespace"))
    held = {}
    for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        declared = contract(table, schema=namespace, order_by=[key])
        held[table] = hf.create_table(spark, declared, bucket_by=(key,), buckets=16)
    orders = frame(spark, sf_dir, "orders")
    held["orders"].append(at_or_before(orders, "o_orderdate", CUTOFF))
    held["lineitem"].append(frame(spark, sf_dir, "lineitem"))
    return hf.fk_orphans(held["lineitem"].read(), "l_orderkey", held["orders"].read(),
                         "o_orderkey")


@query
def create_target_defaults(spark, sf_dir):
    namespace = f"hf_{uuid4().hex}"
    hf.create_namespace(spark, namespace, scratch_path(spark, "namespace"))
    columns = [c.to_dict() for c in contract("customer").columns] + [
        {"name": "c_channel", "type": "varchar(8)", "nullable": False, "default": "web"},
        {"name": "c_rating", "type": "double", "default": 1.5},
    ]
    declared = hf.Contract.from_dict({"table": "customer", "schema": namespace,
                                      "columns": columns})
    target = hf.create_table(spark, declared)
    target.append(frame(spark, sf_dir, "customer"))
    return target.read()


@query
def quoted_names(spark, sf_dir):
    customer = frame(spark, sf_dir, "customer")
    odd = customer.select(col("c_custkey").alias("the key"), col("c_name").alias("full.name"),
                          col("c_acctbal").alias("tick`ed"))
    target = fresh(spark, "customer")
    hf.load_table(odd, target, spec=incremental("the key"))
    hf.load_table(odd, target, spec=incremental("the key"))
    return target.read()


@query
def jdbc_roundtrip(spark, sf_dir):
    """Through an in-memory database inside this process: local sessions only."""
    if not is_local(spark):
        raise RuntimeError("this query's database is only visible to its own process; "
                           "it needs a local session")
    database = hf.Connection("derby", database=f"memory:hf_{uuid4().hex}")
    orders = hf.JdbcTable(spark, database, "orders", partition_column="o_orderkey", partitions=4)
    source = frame(spark, sf_dir, "orders")
    options = hf.LoadOptions(enforce=False)
    early = at_or_before(source, "o_orderdate", CUTOFF)
    hf.load_table(early, orders, spec=incremental("o_orderdate"), options=options)
    hf.load_table(source, orders, spec=incremental("o_orderdate"), options=options)
    target = fresh(spark, "orders")
    hf.load_table(orders, target, contract("orders"))
    return target.read()


# -- loads -------------------------------------------------------------------------------


@query
def incremental_delta(spark, sf_dir):
    orders = frame(spark, sf_dir, "orders")
    target = seeded(spark, "orders", at_or_before(orders, "o_orderdate", CUTOFF))
    return hf.incremental_delta(orders, target, "o_orderdate")


@query
def incremental_load(spark, sf_dir):
    orders = given(spark, sf_dir, "orders")
    target = seeded(spark, "orders", at_or_before(orders.read(), "o_orderdate", CUTOFF))
    hf.load_table(orders, target, spec=incremental("o_orderdate"))
    return target.read()


@query
def incremental_ordered(spark, sf_dir):
    events = given(spark, sf_dir, "events")
    target = seeded(spark, "events", at_or_before(events.read(), "ts", EVENT_CUTOFF))
    mark = target.high_water_mark("ts")
    hf.load_table(events, target, spec=incremental("ts"))
    return target.read_above("ts", mark)


@query
def incremental_bootstrap(spark, sf_dir):
    lineitem = given(spark, sf_dir, "lineitem")
    target = seeded(spark, "lineitem", lineitem.read().limit(0))
    hf.load_table(lineitem, target, spec=incremental("l_shipdate"))
    return target.read()


def _foreign_rows(spark, sf_dir) -> hf.PathTable:
    """A target that holds only rows the source does not have."""
    orders = frame(spark, sf_dir, "orders")
    return seeded(spark, "orders", orders.withColumn("o_orderkey", -col("o_orderkey") - 1))


@query
def full_load(spark, sf_dir):
    target = _foreign_rows(spark, sf_dir)
    hf.load_table(given(spark, sf_dir, "orders"), target, spec=hf.LoadSpec("full"))
    return target.read()


@query
def forced_full_load(spark, sf_dir):
    target = _foreign_rows(spark, sf_dir)
    hf.load_table(given(spark, sf_dir, "orders"), target,
                  spec=incremental("o_orderdate", full_load=True))
    return target.read()


@query
def truncate_incremental(spark, sf_dir):
    target = _foreign_rows(spark, sf_dir)
    hf.load_table(given(spark, sf_dir, "orders"), target,
                  spec=incremental("o_orderdate", truncate=True))
    return target.read()


@query
def append_without_watermark(spark, sf_dir):
    part = given(spark, sf_dir, "part")
    target = seeded(spark, "part", part.read())
    hf.load_table(part, target, spec=incremental(None))
    return target.read()


@query
def watermark_missed_rows(spark, sf_dir):
    orders = frame(spark, sf_dir, "orders")
    early = at_or_before(orders, "o_orderdate", CUTOFF).where("o_orderstatus = 'F'")
    target = seeded(spark, "orders", early)
    hf.load_table(orders, target, spec=incremental("o_orderdate"))
    return hf.missed_rows(orders, target.read(), ["o_orderkey"])


@query
def watermark_missed_null_keys(spark, sf_dir):
    """Keys may be NULL, and rows above the mark are not missed yet."""
    key = F.when(col("o_orderkey") % 10 > 0, col("o_orderkey")).alias("k")
    orders = frame(spark, sf_dir, "orders").select(key, "o_orderdate", "o_orderstatus")
    early = at_or_before(orders, "o_orderdate", CUTOFF).where("o_orderstatus = 'F'")
    target = seeded(spark, "orders", early)
    return hf.missed_rows(orders, target.read(), ["k"], "o_orderdate")


@query
def reconcile_by_digest(spark, sf_dir):
    """A target that lacks the late orders, has others changed, and some twice."""
    orders = frame(spark, sf_dir, "orders")
    price = F.when(col("o_orderkey") % 50 == 0, -col("o_totalprice")).otherwise(
        col("o_totalprice"))
    early = at_or_before(orders, "o_orderdate", CUTOFF).withColumn("o_totalprice", price)
    target = seeded(spark, "orders", early)
    target.append(early.where(col("o_orderkey") % 77 == 1))
    target.append(early.where(col("o_orderkey") % 99 == 2)
                  .withColumn("o_orderkey", -col("o_orderkey")))
    return hf.reconcile_by_digest(orders, target.read(), ["o_orderkey"])


@query
def read_equal_depth(spark, sf_dir):
    """Rows of each of eight splits of a skewed key: at most twice the mean."""
    lineitem = frame(spark, sf_dir, "lineitem")
    # Cubes of keys from about two million on do not fit 64 bits.
    skewed = lineitem.select(F.pow("l_orderkey", F.lit(3)).alias("key"), "l_quantity")
    points = split_points(skewed, "key", 8)
    number = split_number("key", points, skewed.schema["key"].dataType)
    splits = skewed.groupBy(number.alias("split")).agg(F.count(F.lit(1)).alias("n"),
                                                       F.sum("l_quantity").alias("quantity"))
    return splits.agg(F.count(F.lit(1)).alias("splits"), F.sum("n").alias("n"),
                      F.sum("quantity").alias("quantity"),
                      (F.max("n") <= 2 * F.avg("n")).alias("even"))


@query
def catalog_full_load(spark, sf_dir):
    """A full load that fails leaves the table; the next one replaces it."""
    orders = frame(spark, sf_dir, "orders")
    namespace = f"hf_{uuid4().hex}"
    hf.create_namespace(spark, namespace, scratch_path(spark, "namespace"))
    target = hf.CatalogTable(spark, f"{namespace}.orders")
    orders.withColumn("o_orderkey", -col("o_orderkey") - 1).write.saveAsTable(target.name)
    broken = orders.withColumn("o_totalprice", F.when(
        col("o_orderkey") % 100 == 7, F.raise_error(F.lit("broken row")).cast("double"))
        .otherwise(col("o_totalprice")))
    try:
        hf.load_table(broken, target)
    except Exception as error:
        if "broken row" not in str(error):
            raise
    kept = stage(target.read(), "kept").df.select(F.lit("kept").alias("state"), "*")
    hf.load_table(orders, target)
    return kept.unionAll(target.read().select(F.lit("loaded").alias("state"), "*"))


@query
def target_watermark(spark, sf_dir):
    marks = [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]
    found = [
        hf.LoadResult(t, "incremental", 0, given(spark, sf_dir, t).high_water_mark(c))
        for t, c in marks
    ]
    return hf.load_report(spark, found).select("table", "watermark")


def _all_loaded(spark, sf_dir) -> tuple[list[hf.LoadResult], hf.Connection]:
    lake = hf.Connection("parquet", host=scratch_path(spark, "lake"))
    results = hf.load_all(
        spark, contracts(), lambda c: given(spark, sf_dir, c.table),
        lambda c: hf.open_table(spark, lake, c.table))
    return results, lake


@query
def load_all(spark, sf_dir):
    results, lake = _all_loaded(spark, sf_dir)
    reported = hf.load_report(spark, results).select("table", F.col("rows").alias("reported"))
    held = reduce(DataFrame.unionAll, [
        hf.open_table(spark, lake, r.table).read().agg(F.count(F.lit(1)).alias("held"))
        .select(F.lit(r.table).alias("table"), "held")
        for r in results
    ])
    return reported.join(held, "table")


@query
def load_all_resumed(spark, sf_dir):
    """A run whose ``orders`` fail at first: the second attempt loads them and their children,
    and takes the other tables from the ledger."""
    lake = scratch_path(spark, "lake")
    ledger = hf.RunLedger(spark, scratch_path(spark, "runs"), "nightly")

    def attempt(broken: str | None):
        def source(declared):
            if declared.table == broken:
                raise OSError(f"{broken} cannot be reached")
            return given(spark, sf_dir, declared.table)

        return hf.load_all(spark, contracts(), source,
                           lambda c: hf.PathTable(spark, f"{lake}/{c.table}"), ledger=ledger)

    try:
        attempt("orders")
    except hf.LoadError as error:
        first = {r.table for r in error.results}
    else:
        raise AssertionError("the first attempt has to fail")
    results = attempt(None)
    if {r.table for r in results if r.resumed} != first:
        raise AssertionError("a finished table was loaded again")
    return reduce(DataFrame.unionAll, [
        hf.PathTable(spark, f"{lake}/{r.table}").read().agg(F.count(F.lit(1)).alias("held"))
        .select(F.lit(r.table).alias("table"), F.lit(r.resumed).alias("resumed"),
                F.lit(r.rows).cast("long").alias("reported"), "held")
        for r in results])


@query
def list_tables(spark, sf_dir):
    _, lake = _all_loaded(spark, sf_dir)
    names = [r["table"] for r in hf.list_tables(spark, lake).collect()]
    return reduce(DataFrame.unionAll, [
        hf.open_table(spark, lake, n, source=True).read().agg(F.count(F.lit(1)).alias("held"))
        .select(F.lit(n).alias("table"), "held")
        for n in names
    ])


@query
def load_report(spark, sf_dir):
    orders = given(spark, sf_dir, "orders")
    whole, part = fresh(spark, "whole"), fresh(spark, "part")
    part.append(at_or_before(orders.read(), "o_orderdate", CUTOFF))
    results = [
        hf.load_table(orders, whole, spec=hf.LoadSpec("full"), name="whole"),
        hf.load_table(orders, part, spec=incremental("o_orderdate"), name="part"),
        hf.load_table(orders, part, spec=incremental("o_orderdate"), name="again"),
    ]
    return hf.load_report(spark, results).fillna("none", ["watermark"])


@query
def stream_incremental_load(spark, sf_dir):
    events = frame(spark, sf_dir, "events")
    target = fresh(spark, "events")
    arrivals = hf.read_arrivals(spark, f"{sf_dir}/events.parquet", events.schema)
    checkpoint = scratch_path(spark, "stream")
    hf.run_arrivals(arrivals, target, checkpoint)
    hf.run_arrivals(arrivals, target, checkpoint)  # nothing new: adds no row
    return target.read()


@query
def stream_two_checkpoints(spark, sf_dir):
    """Two streams, each with its own checkpoint and run twice, into one target."""
    events = frame(spark, sf_dir, "events")
    target = fresh(spark, "events")
    early = F.col("ts") <= F.lit(EVENT_CUTOFF).cast("timestamp_ntz")
    for part in (early, ~early):
        folder, checkpoint = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
        for kept in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
            events.where(part & kept).write.mode("append").parquet(folder)
            hf.run_arrivals(hf.read_arrivals(spark, folder, events.schema), target, checkpoint)
    return target.read()


# -- constraint checks -------------------------------------------------------------------


@query
def pk_duplicates(spark, sf_dir):
    found = hf.pk_duplicates(frame(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return found.withColumnRenamed("count", "copies")


@query
def unique_violations(spark, sf_dir):
    found = hf.unique_violations(frame(spark, sf_dir, "orders"), "o_custkey")
    return found.withColumnRenamed("count", "copies")


def _graded(spark, sf_dir) -> DataFrame:
    labels = frame(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled")
    documents = frame(spark, sf_dir, "documents")
    return documents.join(labels, documents["doc_id"] == labels["labelled"], "left")


def _graded_contract() -> hf.Contract:
    return hf.Contract.from_dict({"table": "graded", "columns": [
        {"name": "doc_id", "type": "bigint", "primary_key": True},
        {"name": "text", "type": "varchar(255)", "nullable": False},
        {"name": "lang", "type": "char(2)"},
        {"name": "quality", "type": "integer", "nullable": False},
    ]})


@query
def null_violations(spark, sf_dir):
    return hf.null_violations(_graded(spark, sf_dir), _graded_contract())


@query
def length_violations(spark, sf_dir):
    return hf.length_violations(_graded(spark, sf_dir), _graded_contract())


@query
def fk_orphans(spark, sf_dir):
    early = at_or_before(frame(spark, sf_dir, "orders"), "o_orderdate", CUTOFF)
    found = hf.fk_orphans(frame(spark, sf_dir, "lineitem"), "l_orderkey", early, "o_orderkey")
    return found.select(F.col("key").alias("l_orderkey"), F.col("rows").alias("orphan_rows"))


@query
def fk_valid_rows(spark, sf_dir):
    early = at_or_before(frame(spark, sf_dir, "orders"), "o_orderdate", CUTOFF)
    return hf.fk_valid_rows(frame(spark, sf_dir, "lineitem"), "l_orderkey", early, "o_orderkey")


@query
def fk_invalid_rows(spark, sf_dir):
    early = at_or_before(frame(spark, sf_dir, "orders"), "o_orderdate", CUTOFF)
    return hf.fk_invalid_rows(frame(spark, sf_dir, "lineitem"), "l_orderkey", early, "o_orderkey")


@query
def fk_all_relations(spark, sf_dir):
    return hf.fk_report({t: frame(spark, sf_dir, t) for t in TABLES}, contracts())


@query
def pk_conflicts(spark, sf_dir):
    orders = frame(spark, sf_dir, "orders")
    recent = orders.where(col("o_orderdate") >= F.lit(RECENT).cast("timestamp_ntz"))
    return hf.key_conflicts(recent, at_or_before(orders, "o_orderdate", CUTOFF), ["o_orderkey"])


@query
def pk_conflicts_indexed(spark, sf_dir):
    """The same by a key index; a delta of one day's orders opens one of four files."""
    orders = frame(spark, sf_dir, "orders")
    target = fresh(spark, "orders")
    for part in range(4):
        rows = orders.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(4)) == part)
        target.append(at_or_before(rows, "o_orderdate", CUTOFF).coalesce(1))
    index = hf.KeyIndex(target, ["o_orderkey"])
    indexed = index.refresh()
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    last = orders.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(4)) == 3).where(
        col("o_orderkey").between(low, low + (high - low) // 100))
    found = index.candidates(last)
    recent = orders.where(col("o_orderdate") >= F.lit(RECENT).cast("timestamp_ntz"))
    return index.conflicts(recent).select(
        "o_orderkey", F.lit(indexed).alias("indexed"), F.lit(found.skipped > 0).alias("skips"))


def _report_of(report, spark, sf_dir):
    frames = {t: frame(spark, sf_dir, t) for t in TABLES}
    frames["orders"] = at_or_before(frames["orders"], "o_orderdate", CUTOFF)
    frames["graded"] = _graded(spark, sf_dir)
    columns = [c.to_dict() for c in contract("lineitem").columns]
    for column in columns:
        column["primary_key"] = column["name"] in ("l_orderkey", "l_linenumber")
    lineitem = hf.Contract.from_dict({"table": "lineitem", "columns": columns})
    suppliers = [c.to_dict() for c in contract("supplier").columns]
    suppliers[2]["unique"] = True
    supplier = hf.Contract.from_dict({"table": "supplier", "columns": suppliers})
    return report(frames, [lineitem, supplier, _graded_contract()])


@query
def constraint_report(spark, sf_dir):
    return _report_of(hf.constraint_report, spark, sf_dir)


@query
def constraint_report_fused(spark, sf_dir):
    """The same violations with one scan of each table."""
    return _report_of(hf.constraint_report_fused, spark, sf_dir)


# -- values, types, defaults -------------------------------------------------------------


@query
def strip_nul(spark, sf_dir):
    text = F.concat(col("text"), F.lit("\x00x"))
    dirty = frame(spark, sf_dir, "documents").select(
        "doc_id", text.alias("text"), F.array(text, F.lit("\x00")).alias("listed"),
        F.create_map(F.lit("k"), text).alias("mapped"),
        F.struct(text.alias("inner")).alias("nested"))
    tidy = hf.clean(dirty, nested="keep")
    return tidy.select("doc_id", "text", F.col("listed")[0].alias("first"),
                       F.col("listed")[1].alias("second"), F.col("mapped")["k"].alias("mapped"),
                       F.col("nested.inner").alias("nested"))


@query
def nested_to_json(spark, sf_dir):
    documents = frame(spark, sf_dir, "documents")
    nested = documents.select(
        "doc_id",
        F.struct("doc_id", "text", F.lit(None).cast("string").alias("note")).alias("as_struct"),
        F.array("lang", "source").alias("as_array"),
        F.create_map(F.lit("source"), col("source")).alias("as_map"))
    return hf.clean(nested)


@query
def binary_hex(spark, sf_dir):
    documents = frame(spark, sf_dir, "documents").select(
        "doc_id", col("text").cast("binary").alias("raw"))
    return documents.select("doc_id", copy_field(col("raw"), documents.schema["raw"].dataType)
                            .alias("hex"))


@query
def copy_text_export(spark, sf_dir):
    parts = []
    for table in ("documents", "events"):
        path = scratch_path(spark, table)
        hf.write_copy_text(frame(spark, sf_dir, table), path)
        lines = spark.read.option("lineSep", "\n").text(path)
        parts.append(lines.select(F.lit(table).alias("table"), F.col("value").alias("line")))
    return parts[0].unionAll(parts[1])


@query
def copy_text_marks(spark, sf_dir):
    """Tab, carriage return, newline, backslash, NULL, empty text and booleans."""
    texts = F.array(*[F.lit(t) for t in ("a\tb", "a\rb", "a\nb", "a\\b", None, "")])
    orders = frame(spark, sf_dir, "orders").select(
        "o_orderkey", F.get(texts, (col("o_orderkey") % 6).cast("int")).alias("note"),
        F.when(col("o_custkey") % 3 > 0, col("o_custkey") % 3 == 1).alias("flag"))
    path = scratch_path(spark, "marks")
    hf.write_copy_text(orders, path)
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))


@query
def copy_text_roundtrip(spark, sf_dir):
    pages = frame(spark, sf_dir, "pages")
    path = scratch_path(spark, "pages")
    hf.write_copy_text(pages, path)
    return hf.read_copy_text(spark, path, pages.schema)


def _typed_orders() -> hf.Contract:
    return hf.Contract.from_dict({"table": "orders", "columns": [
        {"name": "o_orderkey", "type": "numeric(18)"},
        {"name": "o_custkey", "type": "text"},
        {"name": "o_orderstatus", "type": "char(1)"},
        {"name": "o_totalprice", "type": "numeric(12, 2)"},
        {"name": "o_orderdate", "type": "date"},
        {"name": "o_orderpriority", "type": "varchar(32)"},
        {"name": "o_channel", "type": "text", "default": "web"},
    ]})


@query
def conform_types(spark, sf_dir):
    shaped = hf.conform(frame(spark, sf_dir, "orders"), _typed_orders())
    # Decimals and dates as text, so both engines print them alike.
    return shaped.select(*[col(c).cast("string").alias(c) for c in shaped.columns])


@query
def conform_report(spark, sf_dir):
    declared = hf.Contract.from_dict({"table": "orders", "columns": [
        {"name": "o_orderpriority", "type": "integer"},
        {"name": "o_totalprice", "type": "smallint"},
        {"name": "o_orderdate", "type": "date"},
        {"name": "o_orderkey", "type": "text"},
        {"name": "o_custkey", "type": "bigint"},
        {"name": "o_orderstatus", "type": "text"},
    ]})
    return hf.conform_report(frame(spark, sf_dir, "orders"), declared)


@query
def conform_variant(spark, sf_dir):
    columns = [c.to_dict() | ({"type": "json"} if c.name == "props" else {})
               for c in contract("events").columns]
    declared = hf.Contract.from_dict({"table": "events", "columns": columns})
    target = fresh(spark, "events")
    target.append(hf.conform(frame(spark, sf_dir, "events"), declared, variant=True))
    return target.read().select(
        "event_id", F.schema_of_variant("props").startswith("OBJECT").alias("is_object"),
        F.try_variant_get("props", "$.k", "string").alias("k"))


@query
def conform_variant_report(spark, sf_dir):
    columns = [{"name": "event_type", "type": "json"}, {"name": "props", "type": "json"}]
    declared = hf.Contract.from_dict({"table": "events", "columns": columns})
    rows = frame(spark, sf_dir, "events").select("event_type", "props")
    return hf.conform_report(rows, declared, variant=True)


@query
def default_fill(spark, sf_dir):
    extra = [
        {"name": "d_int", "type": "integer", "default": 7},
        {"name": "d_text", "type": "varchar(10)", "default": "it's"},
        {"name": "d_bool", "type": "boolean", "default": "true"},
        {"name": "d_double", "type": "double", "default": 1.5},
        {"name": "d_numeric", "type": "numeric(10, 2)", "default": "12.5"},
        {"name": "d_date", "type": "date", "default": "2020-02-29"},
    ]
    columns = [c.to_dict() for c in contract("orders").columns] + extra
    declared = hf.Contract.from_dict({"table": "orders", "columns": columns})
    filled = hf.fill_defaults(frame(spark, sf_dir, "orders"), declared)
    return (filled.withColumn("d_numeric", col("d_numeric").cast("string"))
            .withColumn("d_date", col("d_date").cast("string")))


@query
def default_fill_generated(spark, sf_dir):
    columns = [c.to_dict() for c in contract("orders").columns] + [
        {"name": "loaded_at", "type": "timestamptz", "default": "now()"},
        {"name": "row_id", "type": "uuid", "default": "gen_random_uuid()"},
    ]
    declared = hf.Contract.from_dict({"table": "orders", "columns": columns})
    target = fresh(spark, "orders", contract=declared)
    target.append(hf.fill_defaults(frame(spark, sf_dir, "orders"), declared))
    return target.read().select(
        "o_orderkey", F.col("loaded_at").isNotNull().alias("has_clock"),
        F.length("row_id").alias("id_length"))


# -- descriptions ------------------------------------------------------------------------


@query
def describe_tables(spark, sf_dir):
    return reduce(DataFrame.unionAll, [
        hf.describe_rows(t, frame(spark, sf_dir, t)) for t in TABLES])


@query
def infer_watermarks(spark, sf_dir):
    found = []
    for table in TABLES:
        source = given(spark, sf_dir, table)
        described = hf.describe(table, source)
        column = described.load.incremental_column
        mark = source.high_water_mark(column) if column else None
        found.append((table, described.load.mode, column or "none", mark or "none"))
    return spark.createDataFrame(
        found, "table string, mode string, watermark_column string, watermark string")


@query
def contract_summary(spark, sf_dir):
    frames = {t: frame(spark, sf_dir, t) for t in TABLES}
    return hf.contract_summary(spark, contracts(), frames).drop("schema")


@query
def infer_keys(spark, sf_dir):
    """Keys and named references of the given tables, from their rows alone."""
    found = hf.infer_keys({t: frame(spark, sf_dir, t) for t in TABLES})
    return found.where("kind = 'key' or named").drop("named").fillna("")
