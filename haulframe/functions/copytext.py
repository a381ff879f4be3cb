"""Rows as COPY text: tab between fields, newline after records, ``\\N`` for NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from haulframe.functions.clean import NESTED, NUL, nested_to_json, strip_nul
from haulframe.functions.names import col

# Fixed values of the format, in the order they must be applied: backslash first.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
NULL_MARK = "\\N"


def escape(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def copy_field(value: Column, data_type: T.DataType) -> Column:
    """One value as COPY text. NULL is marked last, so a literal ``\\N`` stays apart from it."""
    if isinstance(data_type, T.BooleanType):
        text = F.when(value, "t").when(~value, "f")
    elif isinstance(data_type, T.BinaryType):
        # The format's own \x prefix is escaped too: two backslashes on the wire.
        text = F.concat(F.lit("\\\\x"), F.lower(F.hex(value)))
    elif isinstance(data_type, T.TimestampType):
        # An instant needs its offset; without one the target would read its own zone.
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSSxxx")
    elif isinstance(data_type, NESTED + (T.VariantType,)):
        text = escape(nested_to_json(strip_nul(value, data_type), data_type))
    elif isinstance(data_type, T.StringType):
        text = escape(strip_nul(value, data_type))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(NULL_MARK))


def copy_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Each row as one COPY record, in source column order."""
    fields = [copy_field(col(f.name), f.dataType) for f in df.schema.fields]
    return df.select(F.concat_ws("\t", *fields).alias(line))


def write_copy_text(df: DataFrame, path: str, mode: str = "errorifexists",
                    compression: str = "none") -> None:
    """COPY files under ``path``, one per task."""
    copy_lines(df).write.mode(mode).option("compression", compression).text(path, lineSep="\n")


def read_copy_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """COPY files back as rows of flat types."""
    fields = F.split(F.col("value"), "\t", -1)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(*[
        _field_back(fields.getItem(i), f.dataType).alias(f.name)
        for i, f in enumerate(schema.fields)
    ])


def _field_back(text: Column, data_type: T.DataType) -> Column:
    present = F.when(text != NULL_MARK, text)
    if isinstance(data_type, T.BooleanType):
        return present == "t"
    if isinstance(data_type, T.BinaryType):
        return F.unhex(F.substring(present, 4, 2**31 - 1))
    # NUL cannot occur in the files, so it can stand for an escaped backslash meanwhile.
    plain = F.replace(present, F.lit("\\\\"), F.lit(NUL))
    for raw, written in ESCAPES[1:]:
        plain = F.replace(plain, F.lit(written), F.lit(raw))
    return F.replace(plain, F.lit(NUL), F.lit("\\")).cast(data_type)
