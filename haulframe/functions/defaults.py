"""Column defaults: tidy catalog text, and turn it into a Spark expression."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, functions as F, types as T

# Default texts that mean a clock, a user or a generated id.
CLOCKS = ("now()", "getdate()", "clock_timestamp()", "current_timestamp", "current_timestamp()",
          "sysdate")
UUIDS = ("uuid()", "newid()", "gen_random_uuid()")
USERS = ("current_user", "session_user")
TIMES = ("current_time", "localtime")

_FUNCTION = re.compile(r"^[A-Za-z_]\w*\s*\(.*\)$", re.S)


def is_generated(value: Any) -> bool:
    """True for defaults whose value differs by run or by row."""
    text = str(value).strip().lower()
    return text in CLOCKS + UUIDS + USERS + TIMES + ("localtimestamp", "current_date")


def tidy_default(text: str | None, dialect: str) -> str | None:
    """Catalog default text -> contract default; None where the database numbers the rows."""
    value = (text or "").strip()
    if not value or value == "NULL":
        return None
    lowered = value.lower()
    if dialect in ("postgresql", "duckdb"):
        if value.startswith("nextval("):
            return None
        if dialect == "postgresql" and lowered in ("current_timestamp", "now()"):
            return "CURRENT_TIMESTAMP"
        value = _unquoted(value.split("::", 1)[0].strip())
    elif dialect == "mysql":
        if lowered in ("current_timestamp", "current_timestamp()", "now()"):
            return "CURRENT_TIMESTAMP"
    elif dialect == "sqlserver":
        if "getdate()" in lowered:
            return "CURRENT_TIMESTAMP"
        # ((0)) and ('x') are how the catalog stores plain values.
        while value.startswith("(") and value.endswith(")"):
            value = value[1:-1].strip()
        value = _unquoted(value[1:] if value.startswith("N'") else value)
    return value or None


def _unquoted(value: str) -> str:
    if len(value) >= 2 and value[0] == value[-1] == "'":
        return value[1:-1]
    return value


def default_column(value: Any, data_type: T.DataType) -> Column:
    """Value of a column the source does not have: literal, clock, user or generated id."""
    if value is None:
        return F.lit(None).cast(data_type)
    if not isinstance(value, str):
        return F.lit(value).cast(data_type)
    text = value.strip()
    lowered = text.lower()
    if not text or lowered == "null":
        return F.lit(None).cast(data_type)
    if lowered in CLOCKS:
        return F.current_timestamp().cast(data_type)
    if lowered in UUIDS:
        return F.expr("uuid()").cast(data_type)
    if lowered in USERS:
        return F.current_user().cast(data_type)
    if lowered in TIMES:
        return F.date_format(F.current_timestamp(), "HH:mm:ss.SSSSSS").cast(data_type)
    if lowered == "localtimestamp":
        return F.localtimestamp().cast(data_type)
    if lowered == "current_date":
        return F.current_date().cast(data_type)
    if _FUNCTION.match(text):
        return F.expr(text).cast(data_type)
    return F.lit(text).cast(data_type)


def default_sql(value: Any) -> str:
    """DEFAULT clause text for CREATE TABLE (a constant Spark can fold, or a clock)."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if not isinstance(value, str):
        return str(value)
    text = value.strip()
    lowered = text.lower()
    if lowered in CLOCKS or lowered == "localtimestamp":
        return "current_timestamp()"
    if lowered == "current_date":
        return "current_date()"
    if lowered in USERS:
        return "current_user()"
    if _FUNCTION.match(text):
        return text
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
