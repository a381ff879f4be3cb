"""Column references that survive spaces, dots and back-ticks in names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Top-level column by its exact name."""
    return F.col(quoted(name))
