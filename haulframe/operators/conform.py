"""Shape rows to a target: columns by name, types by contract, defaults where absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from haulframe.contract import ColumnSpec, Contract
from haulframe.functions.defaults import default_column
from haulframe.functions.names import col
from haulframe.functions.types import base_and_args


def _case_sensitive(df: DataFrame) -> bool:
    return df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"


def match_names(df: DataFrame, wanted: list[str]) -> dict[str, str]:
    """Wanted name -> source column, by the session's case rule; unknown columns are an error."""
    fold = (lambda n: n) if _case_sensitive(df) else str.lower
    have = {fold(name): name for name in df.columns}
    extra = [name for key, name in have.items() if key not in {fold(w) for w in wanted}]
    if extra:
        raise ValueError(f"columns the target does not have: {extra}")
    return {name: have[fold(name)] for name in wanted if fold(name) in have}


def align(df: DataFrame, schema: T.StructType,
          defaults: dict[str, Column] | None = None) -> DataFrame:
    """Columns in target order, matched by name; missing ones take their default or NULL."""
    found = match_names(df, schema.names)
    defaults = defaults or {}
    return df.select(*[
        (_to_type(df, found[f.name], f.dataType) if f.name in found
         else defaults.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def _to_type(df: DataFrame, name: str, data_type: T.DataType) -> Column:
    if df.schema[name].dataType == data_type:
        return col(name)
    return strict_cast(col(name), data_type, name, df.schema[name].dataType)


def fits(value: Column, data_type: T.DataType, source: T.DataType | None = None) -> Column:
    """False for a value the type has no place for, or only without its fraction."""
    cast = value.try_cast(data_type)
    good = cast.isNotNull()
    fraction = isinstance(source, T.FractionalType) and (
        isinstance(data_type, T.IntegralType)
        or isinstance(source, T.DecimalType) and isinstance(data_type, T.DecimalType)
        and data_type.scale < source.scale)
    if fraction:
        # Compared as the wider of the two, so an exact value stays exact.
        good = good & (cast.cast(source if isinstance(source, T.DecimalType) else "double")
                       == value)
    return F.when(value.isNull(), True).otherwise(F.coalesce(good, F.lit(False)))


def strict_cast(value: Column, data_type: T.DataType, name: str,
                source: T.DataType | None = None) -> Column:
    """Cast that fails on a value that does not fit, whatever the session's ANSI setting.

    With the type of the source, a number that would lose its fraction does not fit either.
    """
    cast = value.try_cast(data_type)
    complaint = F.concat(F.lit(f"column {name}: no {data_type.simpleString()} for value "),
                         value.cast("string"))
    return F.when(~fits(value, data_type, source),
                  F.raise_error(complaint).cast(data_type)).otherwise(cast)


def _source_value(df: DataFrame, name: str, spec: ColumnSpec) -> Column:
    """Source column ready to cast: a time of day becomes text, not a 1970 timestamp."""
    source = df.schema[name].dataType
    if base_and_args(spec.type)[0] in ("time", "timetz") and isinstance(
            source, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col(name), "HH:mm:ss.SSSSSS")
    return col(name)


def _is_json(spec: ColumnSpec) -> bool:
    return base_and_args(spec.type)[0] == "json"


def _parsed(value: Column, source: T.DataType) -> Column:
    """JSON text as a variant; NULL where it is none. A nested value is its own JSON."""
    if isinstance(source, T.VariantType):
        return value
    if isinstance(source, (T.StructType, T.ArrayType, T.MapType)):
        value = F.to_json(value)
    return F.try_parse_json(value.cast("string"))


def conform(df: DataFrame, contract: Contract, extras: str = "error",
            variant: bool = False) -> DataFrame:
    """Rows with exactly the contract's columns and types.

    With ``variant``, json columns become variants, which are parsed once and read by path
    without parsing again; text that is no JSON fails the job.

    A value that does not fit its type fails the job. A column the source lacks takes its
    default. Source columns outside the contract fail, or go away with ``extras="drop"``.
    """
    names = [c.name for c in contract.columns]
    if extras == "drop":
        fold = (lambda n: n) if _case_sensitive(df) else str.lower
        keep = {fold(n) for n in names}
        df = df.select(*[col(n) for n in df.columns if fold(n) in keep])
    found = match_names(df, names)
    chosen = []
    for spec in contract.columns:
        if spec.name not in found:
            value = default_column(spec.default, spec.spark_type)
            if variant and _is_json(spec):
                value = F.parse_json(value)
        elif variant and _is_json(spec):
            value = _parsed(col(found[spec.name]), df.schema[found[spec.name]].dataType)
            complaint = f"column {spec.name}: no JSON for value "
            text = col(found[spec.name])
            value = F.when(text.isNotNull() & value.isNull(), F.raise_error(F.concat(
                F.lit(complaint), text.cast("string"))).cast("variant")).otherwise(value)
        else:
            value = _source_value(df, found[spec.name], spec)
            if df.schema[found[spec.name]].dataType != spec.spark_type:
                value = strict_cast(value, spec.spark_type, spec.name,
                                    df.schema[found[spec.name]].dataType)
        chosen.append(value.alias(spec.name))
    return df.select(*chosen)


def fill_defaults(df: DataFrame, contract: Contract) -> DataFrame:
    """Add the contract columns the source lacks, at their default."""
    found = match_names(df, [c.name for c in contract.columns])
    return df.select(*[
        col(found[c.name]).alias(c.name) if c.name in found
        else default_column(c.default, c.spark_type).alias(c.name)
        for c in contract.columns
    ])


def conform_report(df: DataFrame, contract: Contract, variant: bool = False) -> DataFrame:
    """Per column, how many values would not fit the contract type. One pass, no failure.

    With ``variant``, text in json columns must be JSON.
    """
    found = match_names(df, [c.name for c in contract.columns])
    specs = [c for c in contract.columns if c.name in found]
    counts = []
    for i, c in enumerate(specs):
        source = df.schema[found[c.name]].dataType
        good = fits(_source_value(df, found[c.name], c), c.spark_type, source)
        if variant and _is_json(c):
            value = col(found[c.name])
            good = value.isNull() | _parsed(value, source).isNotNull()
        counts.append(F.count_if(~good).alias(f"n{i}"))
    labels = [(contract.table, c.name, df.schema[found[c.name]].dataType.simpleString(), c.type)
              for c in specs]
    return unpivot(df.agg(*counts), labels, ("table", "column", "from_type", "to_type"),
                   [[F.col(f"n{i}").alias("failures")] for i in range(len(specs))])


def unpivot(one_row: DataFrame, labels: list[tuple], names: tuple[str, ...],
            values: list[list[Column]]) -> DataFrame:
    """One aggregate row -> one row per label, with that label's values."""
    entries = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, label)], *picked)
        for label, picked in zip(labels, values)
    ]
    return one_row.select(F.inline(F.array(*entries)))
