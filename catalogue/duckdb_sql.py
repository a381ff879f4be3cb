"""The same queries as SQL over the given tables."""

from __future__ import annotations

from itertools import combinations

from catalogue.contracts import TABLES, contract

CUT = "TIMESTAMP '1999-01-01 00:00:00'"
EARLY_ORDERS = f"(SELECT * FROM orders WHERE o_orderdate <= {CUT})"
GRADED = "(SELECT d.*, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _escaped(column: str) -> str:
    """Column as COPY text: backslash first, then tab, newline and carriage return."""
    text = f"replace({column}, chr(92), chr(92) || chr(92))"
    for code, letter in ((9, "t"), (10, "n"), (13, "r")):
        text = f"replace({text}, chr({code}), chr(92) || '{letter}')"
    return f"coalesce({text}, chr(92) || 'N')"


def _plain(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), chr(92) || 'N')"


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _count_nulls(table: str, position: int, column: str, kind: str) -> str:
    return (f"SELECT '{table}' AS \"table\", {position} AS position, '{column}' AS \"column\", "
            f"'{kind}' AS type, count(*) AS row_count, count(*) - count({column}) AS null_count "
            f"FROM {table}")


def _summary(table: str) -> str:
    columns = contract(table).columns
    keys = sum(c.primary_key for c in columns)
    references = sum(c.foreign_key is not None for c in columns)
    declared = {"columns": len(columns), "primary_keys": keys, "foreign_keys": references,
                "uniques": 0, "required": keys}
    counts = ", ".join(f"CAST({n} AS BIGINT) AS {name}" for name, n in declared.items())
    return f"SELECT '{table}' AS \"table\", {counts}, count(*) AS \"rows\" FROM {table}"


def _orphan_count(child: str, column: str, parent: str, key: str) -> str:
    return (f"SELECT '{child}' AS child, '{column}' AS \"column\", '{parent}' AS parent, "
            f"'{key}' AS parent_column, count(*) AS orphan_rows FROM {child} c "
            f"WHERE c.{column} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})")


def _violations(table: str, constraint: str, column: str, source: str) -> str:
    return (f"SELECT '{table}' AS \"table\", '{constraint}' AS \"constraint\", "
            f"'{column}' AS \"column\", CAST(violations AS BIGINT) AS violations FROM ({source})")


def _nulls(table: str, source: str, column: str) -> str:
    return _violations(table, "not_null", column,
                       f"SELECT count(*) - count({column}) AS violations FROM {source}")


def _too_long(table: str, source: str, column: str, limit: int) -> str:
    return _violations(
        table, "length", column,
        f"SELECT count(*) FILTER (WHERE length({column}) > {limit}) AS violations FROM {source}")


def _repeats(table: str, constraint: str, source: str, keys: str) -> str:
    return _violations(
        table, constraint, keys,
        f"SELECT coalesce(sum(n - 1), 0) AS violations FROM "
        f"(SELECT count(*) AS n FROM {source} GROUP BY {keys})")


def _orphans(table: str, column: str, parent: str, key: str) -> str:
    return _violations(
        table, "foreign_key", column,
        f"SELECT count(*) AS violations FROM {table} c WHERE c.{column} IS NOT NULL AND "
        f"NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})")


def _misfits(column: str, source: str, target: str, cast: str) -> str:
    return (f"SELECT 'orders' AS \"table\", '{column}' AS \"column\", '{source}' AS from_type, "
            f"'{target}' AS to_type, count(*) FILTER (WHERE {column} IS NOT NULL "
            f"AND TRY_CAST({column} AS {cast}) IS NULL) AS failures FROM orders")


ORDERS = "SELECT * FROM orders"
GRADED_NULLS = [_nulls("graded", GRADED, c) for c in ("doc_id", "text", "quality")]
GRADED_LENGTHS = [_too_long("graded", GRADED, "text", 255), _too_long("graded", GRADED, "lang", 2)]
# Marks the inference rules find.
MARKS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}

CONSTRAINTS = _union([
    _nulls("lineitem", "lineitem", "l_orderkey"),
    _nulls("lineitem", "lineitem", "l_linenumber"),
    _repeats("lineitem", "primary_key", "lineitem", "l_orderkey,l_linenumber"),
    _orphans("lineitem", "l_orderkey", EARLY_ORDERS, "o_orderkey"),
    _orphans("lineitem", "l_partkey", "part", "p_partkey"),
    _orphans("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    _nulls("supplier", "supplier", "s_suppkey"),
    _repeats("supplier", "primary_key", "supplier", "s_suppkey"),
    _repeats("supplier", "unique", "supplier", "s_nationkey"),
    _orphans("supplier", "s_nationkey", "nation", "n_nationkey"),
    *GRADED_NULLS, *GRADED_LENGTHS,
    _repeats("graded", "primary_key", GRADED, "doc_id"),
])



def _key_like(table: str) -> list[str]:
    """Columns that may be keys: neither fractions nor lists."""
    return [c.name for c in contract(table).columns if not c.type.startswith(("double", "array"))]


def _inferred() -> str:
    """Single keys, pairs in tables without one, and references to single keys by name."""
    whole = {(t, c): f"(SELECT count(DISTINCT {c}) = count(*) AND count({c}) = count(*) FROM {t})"
             for t in TABLES for c in _key_like(t)}
    kinds = {(t, c.name): c.type.replace("bigint", "integer")
             for t in TABLES for c in contract(t).columns}

    def row(kind, table, columns, parent, key, holds):
        return (f"SELECT '{kind}' AS kind, '{table}' AS \"table\", '{columns}' AS columns, "
                f"'{parent}' AS parent, '{key}' AS parent_column WHERE {holds}")

    parts = [row("key", t, c, "", "", holds) for (t, c), holds in whole.items()]
    for t in TABLES:
        none = " AND ".join(f"NOT {whole[t, c]}" for c in _key_like(t))
        parts += [row("key", t, f"{a},{b}", "", "", f"{none} AND (SELECT "
                      f"count(DISTINCT ({a}, {b})) = count(*) AND count({a}) = count(*) AND "
                      f"count({b}) = count(*) FROM {t})")
                  for a, b in combinations(_key_like(t), 2)]
    for (t, c), _ in whole.items():
        for (p, k), unique in whole.items():
            stems = [n.partition("_") for n in (c, k)]
            short = all(0 < len(s[0]) <= 2 for s in stems) and stems[0][2] == stems[1][2]
            named = c == k or c in (f"{p}_{k}", f"{p.removesuffix('s')}_{k}") or short
            if t != p and named and kinds[t, c] == kinds[p, k]:
                parts.append(row("reference", t, c, p, k, f"{unique} AND NOT EXISTS (SELECT 1 "
                                 f"FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN "
                                 f"(SELECT {k} FROM {p}))"))
    return _union(parts)


SQL = {
    "scan_table": "SELECT * FROM lineitem",
    "scan_path_table": "SELECT * FROM events",
    "append_path_table": "SELECT * FROM customer UNION ALL SELECT * FROM customer",
    "append_by_name": "SELECT * FROM customer UNION ALL SELECT * FROM customer",
    "truncate_target":
        "SELECT count(*) AS seeded, CAST(0 AS BIGINT) AS n, 6 AS columns FROM orders",
    "layout_partitioned": ORDERS,
    "layout_clustered": "SELECT *, true AS few_files FROM orders",
    "bucketed_references":
        "SELECT l_orderkey AS key, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN "
        f"(SELECT o_orderkey FROM {EARLY_ORDERS}) GROUP BY l_orderkey",
    "create_target_defaults":
        "SELECT *, 'web' AS c_channel, CAST(1.5 AS DOUBLE) AS c_rating FROM customer",
    "quoted_names": 'SELECT c_custkey AS "the key", c_name AS "full.name", '
                    'c_acctbal AS "tick`ed" FROM customer',
    "jdbc_roundtrip": ORDERS,
    "incremental_delta":
        f"SELECT * FROM orders WHERE o_orderdate > "
        f"(SELECT max(o_orderdate) FROM {EARLY_ORDERS})",
    "incremental_load": ORDERS,
    "incremental_ordered":
        "SELECT * FROM events WHERE ts > "
        "(SELECT max(ts) FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00')",
    "incremental_bootstrap": "SELECT * FROM lineitem",
    "full_load": ORDERS,
    "forced_full_load": ORDERS,
    "truncate_incremental": ORDERS,
    "append_without_watermark": "SELECT * FROM part UNION ALL SELECT * FROM part",
    "watermark_missed_rows":
        f"SELECT * FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= "
        f"(SELECT max(o_orderdate) FROM {EARLY_ORDERS} WHERE o_orderstatus = 'F')",
    "watermark_missed_null_keys":
        "WITH o AS (SELECT CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey END AS k, o_orderdate, "
        "o_orderstatus FROM orders), "
        f"e AS (SELECT CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey END AS k, o_orderdate "
        f"FROM {EARLY_ORDERS} WHERE o_orderstatus = 'F') "
        "SELECT * FROM o WHERE o_orderdate <= (SELECT max(o_orderdate) FROM e) "
        "AND NOT EXISTS (SELECT 1 FROM e WHERE e.k IS NOT DISTINCT FROM o.k)",
    "catalog_full_load":
        "SELECT 'kept' AS state, * REPLACE (-o_orderkey - 1 AS o_orderkey) FROM orders "
        "UNION ALL SELECT 'loaded', * FROM orders",
    "target_watermark": _union([
        f"SELECT '{t}' AS \"table\", CAST(max({c}) AS VARCHAR) AS watermark FROM {t}"
        for t, c in MARKS.items()]),
    "load_all": _union([
        f"SELECT '{t}' AS \"table\", count(*) AS reported, count(*) AS held FROM {t}"
        for t in TABLES]),
    "load_all_resumed": _union([
        f"SELECT '{t}' AS \"table\", {t not in ('orders', 'lineitem')} AS resumed, "
        f"count(*) AS reported, count(*) AS held FROM {t}"
        for t in TABLES]),
    "list_tables": _union([
        f"SELECT '{t}' AS \"table\", count(*) AS held FROM {t}" for t in TABLES]),
    "load_report":
        "SELECT 'whole' AS \"table\", 'full' AS kind, count(*) AS \"rows\", 'none' AS watermark "
        "FROM orders UNION ALL "
        "SELECT 'part', 'incremental', count(*) FILTER (WHERE o_orderdate > "
        f"(SELECT max(o_orderdate) FROM {EARLY_ORDERS})), CAST(max(o_orderdate) AS VARCHAR) "
        "FROM orders UNION ALL "
        "SELECT 'again', 'incremental', 0, CAST(max(o_orderdate) AS VARCHAR) FROM orders",
    "stream_incremental_load": "SELECT * FROM events",
    "stream_two_checkpoints": "SELECT * FROM events",
    "reconcile_by_digest":
        "WITH early AS (SELECT * FROM orders "
        f"WHERE o_orderdate <= {CUT}) "
        "SELECT o_orderkey, 'missing' AS status, 1::BIGINT AS source_rows, "
        "0::BIGINT AS target_rows FROM orders "
        f"WHERE o_orderdate > {CUT} "
        "UNION ALL SELECT -o_orderkey, 'extra', 0, 1 FROM early WHERE o_orderkey % 99 = 2 "
        "UNION ALL SELECT o_orderkey, 'changed', 1, 1 + (o_orderkey % 77 = 1)::INT FROM early "
        "WHERE o_orderkey % 77 = 1 OR (o_orderkey % 50 = 0 AND o_totalprice <> 0)",
    "read_equal_depth":
        "SELECT 8::BIGINT AS splits, count(*) AS n, sum(l_quantity) AS quantity, true AS even "
        "FROM lineitem",
    "pk_duplicates":
        "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem "
        "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "unique_violations":
        "SELECT o_custkey, count(*) AS copies FROM orders WHERE o_custkey IS NOT NULL "
        "GROUP BY o_custkey HAVING count(*) > 1",
    "null_violations": _union(GRADED_NULLS),
    "length_violations": _union(GRADED_LENGTHS),
    "fk_orphans":
        f"SELECT l_orderkey, count(*) AS orphan_rows FROM lineitem l WHERE l_orderkey IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM {EARLY_ORDERS} o WHERE o.o_orderkey = l.l_orderkey) "
        "GROUP BY l_orderkey",
    "fk_valid_rows":
        f"SELECT * FROM lineitem l WHERE l_orderkey IS NULL OR EXISTS "
        f"(SELECT 1 FROM {EARLY_ORDERS} o WHERE o.o_orderkey = l.l_orderkey)",
    "fk_invalid_rows":
        f"SELECT * FROM lineitem l WHERE l_orderkey IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {EARLY_ORDERS} o WHERE o.o_orderkey = l.l_orderkey)",
    "fk_all_relations": _union([
        _orphan_count(t, column, key.table, key.column)
        for t in TABLES for column, key in contract(t).foreign_keys]),
    "pk_conflicts":
        f"SELECT o_orderkey FROM {EARLY_ORDERS} "
        "WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'",
    "pk_conflicts_indexed":
        f"SELECT o_orderkey, 4 AS indexed, true AS skips FROM {EARLY_ORDERS} "
        "WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'",
    "constraint_report": CONSTRAINTS,
    "constraint_report_fused": CONSTRAINTS,
    "strip_nul":
        "SELECT doc_id, text || 'x' AS text, text || 'x' AS \"first\", '' AS \"second\", "
        "text || 'x' AS mapped, text || 'x' AS nested FROM documents",
    "nested_to_json":
        "SELECT doc_id, "
        "CAST(to_json({'doc_id': doc_id, 'text': text, 'note': NULL}) AS VARCHAR) AS as_struct, "
        "CAST(to_json([lang, source]) AS VARCHAR) AS as_array, "
        "CAST(to_json({'source': source}) AS VARCHAR) AS as_map FROM documents",
    "binary_hex":
        "SELECT doc_id, chr(92) || chr(92) || 'x' || lower(hex(encode(text))) AS hex "
        "FROM documents",
    "copy_text_export":
        "SELECT 'documents' AS \"table\", " + " || chr(9) || ".join([
            _plain("doc_id"), _escaped("text"), _escaped("lang"), _escaped("source"),
            _plain("n_chars")]) + " AS line FROM documents UNION ALL "
        "SELECT 'events', " + " || chr(9) || ".join([
            _plain("event_id"), _plain("ts"), _plain("user_id"), _escaped("event_type"),
            _plain("value"), _escaped("props")]) + " FROM events",
    "copy_text_marks":
        "SELECT CAST(o_orderkey AS VARCHAR) || chr(9) || CASE o_orderkey % 6 "
        "WHEN 0 THEN 'a\\tb' WHEN 1 THEN 'a\\rb' WHEN 2 THEN 'a\\nb' WHEN 3 THEN 'a\\\\b' "
        "WHEN 4 THEN '\\N' ELSE '' END || chr(9) || "
        "CASE WHEN o_custkey % 3 = 0 THEN '\\N' WHEN o_custkey % 3 = 1 THEN 't' ELSE 'f' END "
        "AS line FROM orders",
    "copy_text_roundtrip": "SELECT * FROM pages",
    "conform_types":
        "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, "
        "CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, "
        "CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) AS o_totalprice, "
        "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority, "
        "'web' AS o_channel FROM orders",
    "conform_report": _union([
        _misfits("o_orderpriority", "string", "integer", "INTEGER"),
        # A value that would lose its fraction does not fit either.
        "SELECT 'orders' AS \"table\", 'o_totalprice' AS \"column\", 'double' AS from_type, "
        "'smallint' AS to_type, count(*) FILTER (WHERE o_totalprice IS NOT NULL AND ("
        "TRY_CAST(o_totalprice AS SMALLINT) IS NULL OR o_totalprice <> trunc(o_totalprice))) "
        "AS failures FROM orders",
        _misfits("o_orderdate", "timestamp_ntz", "date", "DATE"),
        _misfits("o_orderkey", "bigint", "text", "VARCHAR"),
        _misfits("o_custkey", "bigint", "bigint", "BIGINT"),
        _misfits("o_orderstatus", "string", "text", "VARCHAR"),
    ]),
    "conform_variant":
        "SELECT event_id, json_type(props) = 'OBJECT' AS is_object, "
        "json_extract_string(props, '$.k') AS k FROM events",
    "conform_variant_report": _union([
        f"SELECT 'events' AS \"table\", '{c}' AS \"column\", 'string' AS from_type, "
        f"'json' AS to_type, count(*) FILTER (WHERE {c} IS NOT NULL AND NOT json_valid({c})) "
        "AS failures FROM events" for c in ("event_type", "props")]),
    "default_fill":
        "SELECT *, 7 AS d_int, 'it''s' AS d_text, true AS d_bool, "
        "CAST(1.5 AS DOUBLE) AS d_double, '12.50' AS d_numeric, '2020-02-29' AS d_date "
        "FROM orders",
    "default_fill_generated":
        "SELECT o_orderkey, true AS has_clock, 36 AS id_length FROM orders",
    "describe_tables": _union([
        _count_nulls(t, i + 1, c.name, c.type)
        for t in TABLES for i, c in enumerate(contract(t).columns)]),
    "infer_keys": _inferred(),
    "infer_watermarks": _union([
        f"SELECT '{t}' AS \"table\", 'incremental' AS mode, '{MARKS[t]}' AS watermark_column, "
        f"CAST(max({MARKS[t]}) AS VARCHAR) AS watermark FROM {t}" if t in MARKS else
        f"SELECT '{t}' AS \"table\", 'full' AS mode, 'none' AS watermark_column, "
        "'none' AS watermark" for t in TABLES]),
    "contract_summary": _union([_summary(t) for t in TABLES]),
}
