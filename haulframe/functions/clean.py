"""Value cleaning, built from the schema as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from haulframe.functions.names import col

NUL = "\x00"
NESTED = (T.ArrayType, T.MapType, T.StructType)


def holds_text(data_type: T.DataType) -> bool:
    """True where NULs can hide. Map keys do not count: they stay as they are."""
    if isinstance(data_type, T.StringType):
        return True
    if isinstance(data_type, T.ArrayType):
        return holds_text(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return holds_text(data_type.valueType)
    if isinstance(data_type, T.StructType):
        return any(holds_text(field.dataType) for field in data_type.fields)
    return False


def strip_nul(value: Column, data_type: T.DataType) -> Column:
    """Drop NUL characters from text at any depth.

    ``replace`` hands back the same bytes when nothing matches, so clean text costs one search.
    """
    if not holds_text(data_type):
        return value
    if isinstance(data_type, T.StringType):
        return F.replace(value, F.lit(NUL), F.lit(""))
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: strip_nul(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(value, lambda _, item: strip_nul(item, data_type.valueType))
    rebuilt = F.struct(*[
        strip_nul(value.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields
    ])
    return F.when(value.isNotNull(), rebuilt)


def nested_to_json(value: Column, data_type: T.DataType) -> Column:
    """Arrays, maps, structs and variants as compact JSON text; null fields are kept."""
    if isinstance(data_type, T.VariantType):
        return F.to_json(value)
    if isinstance(data_type, NESTED):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value


def clean_column(value: Column, data_type: T.DataType, nested: str = "json") -> Column:
    value = strip_nul(value, data_type)
    return nested_to_json(value, data_type) if nested == "json" else value


def clean(df: DataFrame, nested: str = "json", keep: set[str] = frozenset()) -> DataFrame:
    """Strip NULs everywhere and, unless ``nested="keep"``, write nested values as JSON text.

    ``keep`` names columns that stay nested. Columns with nothing to clean are passed through as
    they are, so they stay prunable.
    """
    if nested not in ("json", "keep"):
        raise ValueError(f"nested must be 'json' or 'keep', not {nested!r}")
    return df.select(*[
        clean_column(col(f.name), f.dataType, "keep" if f.name in keep else nested).alias(f.name)
        if holds_text(f.dataType) or isinstance(f.dataType, NESTED + (T.VariantType,))
        else col(f.name)
        for f in df.schema.fields
    ])


def nested_columns(schema: T.StructType | None) -> set[str]:
    """Columns a target holds as nested values, so they need no JSON text."""
    return {f.name for f in (schema or T.StructType()).fields if isinstance(f.dataType, NESTED)}
