"""Type names: native database names -> contract names -> Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The native type names each contract type stands for.
NATIVE_NAMES = {
    "varchar": ("character varying", "varchar", "nvarchar", "varchar2", "nvarchar2"),
    "char": ("character", "char", "nchar", "bpchar"),
    "text": ("text", "tinytext", "mediumtext", "longtext", "ntext", "string", "utf8",
             "large_string", "clob"),
    "numeric": ("numeric", "decimal"),
    "integer": ("int", "integer", "int4", "int32", "serial", "serial4", "mediumint", "uint16"),
    "bigint": ("bigint", "int64", "bigserial", "serial8", "int128", "int256", "uint32", "uint64",
               "uint128", "uint256", "hugeint", "uhugeint", "long"),
    "smallint": ("smallint", "int2", "int16", "uint8", "short"),
    "tinyint": ("tinyint", "int1", "int8", "byte"),
    "boolean": ("boolean", "bool", "bit"),
    "timestamp": ("timestamp without time zone", "timestamp", "datetime", "datetime2",
                  "smalldatetime", "timestamp_ntz"),
    "timestamptz": ("timestamp with time zone", "timestamptz", "datetimeoffset", "timestamp_ltz"),
    "date": ("date", "date32", "date64"),
    "time": ("time", "time without time zone"),
    "timetz": ("time with time zone", "timetz"),
    "double": ("double precision", "double", "float8", "float64"),
    "float": ("real", "float", "float4", "float32"),
    "uuid": ("uuid", "uniqueidentifier"),
    "json": ("json", "jsonb"),
    "binary": ("bytea", "blob", "tinyblob", "mediumblob", "longblob", "binary", "varbinary",
               "image", "large_binary"),
    "enum": ("enum", "enum8", "enum16"),
    "xml": ("xml",),
}
# Money types have a set precision.
MONEY = {"money": "numeric(19, 4)", "smallmoney": "numeric(10, 4)"}
# Native names of nested and interval types, which load as text.
NESTED_NAMES = ("array", "list", "map", "struct", "tuple", "row", "nested", "union", "interval")

_BY_NATIVE = {native: name for name, natives in NATIVE_NAMES.items() for native in natives}
_CALL = re.compile(r"^\s*([^(\[]+?)\s*[(\[](.*)[)\]]\s*$", re.S)

_SPARK = {
    "text": T.StringType(), "varchar": T.StringType(), "char": T.StringType(),
    "integer": T.IntegerType(), "bigint": T.LongType(), "smallint": T.ShortType(),
    "tinyint": T.ByteType(), "boolean": T.BooleanType(), "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "date": T.DateType(), "double": T.DoubleType(),
    "float": T.FloatType(), "binary": T.BinaryType(),
    # Spark has no time-of-day column by default and no uuid, enum or xml: kept as text.
    "time": T.StringType(), "timetz": T.StringType(), "uuid": T.StringType(),
    "json": T.StringType(), "enum": T.StringType(), "xml": T.StringType(),
    "user-defined": T.StringType(),
}
_NAMES = {
    T.StringType: "text", T.IntegerType: "integer", T.LongType: "bigint",
    T.ShortType: "smallint", T.ByteType: "tinyint", T.BooleanType: "boolean",
    T.TimestampNTZType: "timestamp", T.TimestampType: "timestamptz", T.DateType: "date",
    T.DoubleType: "double", T.FloatType: "float", T.BinaryType: "binary",
    T.VariantType: "json",
}


def contract_type(native: str | None, length: int | None = None,
                  precision: int | None = None, scale: int | None = None) -> str:
    """Contract name of a native type; size arguments may come apart or inside the text.

    Unknown types (arrays, maps, structs, intervals) come back as lower-case text.
    """
    text = (native or "").strip().lower()
    if text in MONEY:
        return MONEY[text]
    if text.endswith("]") and not text.startswith(("timestamp[", "time32[", "time64[")):
        return text
    call = _CALL.match(text)
    if call and text not in _BY_NATIVE:
        head, inner = call.group(1).strip(), call.group(2)
        if head in ("nullable", "lowcardinality"):
            return contract_type(inner, length, precision, scale)
        sizes = [int(n) for n in re.findall(r"\d+", inner)]
        if head == "fixedstring":
            head = "char"
        elif head == "datetime64":
            head = "timestamp"
        elif head in ("time32", "time64"):
            head = "time"
        elif head == "timestamp" and "tz=" in inner:
            head = "timestamptz"
        name = _BY_NATIVE.get(head)
        if name is None:
            return text
        if name in ("varchar", "char"):
            return _sized(name, sizes[0] if sizes else None)
        if name == "numeric":
            return _numeric(*(sizes + [None, None])[:2])
        return name
    if text == "datetime64":
        return "timestamp"
    name = _BY_NATIVE.get(text)
    if name is None:
        return text
    if name in ("varchar", "char"):
        return _sized(name, length)
    if name == "numeric":
        return _numeric(precision, scale)
    return name


def _sized(name: str, length: int | None) -> str:
    if length is not None and length > 0:
        return f"{name}({length})"
    return "text" if name == "varchar" else name


def _numeric(precision: int | None, scale: int | None) -> str:
    if precision is None:
        return "numeric"
    return f"numeric({precision}, {scale})" if scale else f"numeric({precision})"


def contract_type_of(field: T.StructField) -> str:
    """Contract name of a Spark field; keeps a CHAR/VARCHAR length Spark holds as metadata."""
    declared = (field.metadata or {}).get("__CHAR_VARCHAR_TYPE_STRING")
    if declared:
        return contract_type(declared)
    data_type = field.dataType
    if isinstance(data_type, T.DecimalType):
        return _numeric(data_type.precision, data_type.scale)
    if isinstance(data_type, (T.VarcharType, T.CharType)):
        return contract_type(data_type.simpleString())
    if type(data_type).__name__ == "TimeType":
        return "time"
    for spark_class, name in _NAMES.items():
        if isinstance(data_type, spark_class):
            return name
    return data_type.simpleString().lower()


def base_and_args(type_text: str) -> tuple[str, list[int]]:
    """``numeric(10, 2)`` -> ``("numeric", [10, 2])`` after resolving native aliases."""
    name = contract_type(type_text)
    call = None if name.endswith("]") else _CALL.match(name)
    if not call:
        return name, []
    return call.group(1).strip(), [int(n) for n in re.findall(r"\d+", call.group(2))]


def spark_type(type_text: str) -> T.DataType:
    """Spark type a frame column takes for a contract type."""
    if type_text.strip().lower() == "user-defined":
        return T.StringType()
    base, args = base_and_args(type_text)
    if base == "numeric":
        if not args:
            return T.DecimalType(38, 18)
        return T.DecimalType(args[0], args[1] if len(args) > 1 else 0)
    if base in _SPARK:
        return _SPARK[base]
    try:
        return T.DataType.fromDDL(type_text)
    except Exception:
        # Another database's spelling of a nested type: such values arrive as JSON text.
        if base.endswith("]") or base.split("(")[0].split(" ")[0] in NESTED_NAMES:
            return T.StringType()
        raise ValueError(f"unknown column type {type_text!r}") from None


def table_type(type_text: str) -> str:
    """Type text for CREATE TABLE: VARCHAR(n) and CHAR(n) keep their length."""
    base, args = base_and_args(type_text)
    if base in ("varchar", "char") and args:
        return f"{base.upper()}({args[0]})"
    return spark_type(type_text).simpleString()


def max_length(type_text: str) -> int | None:
    """Length limit of a varchar(n) / char(n) contract type."""
    base, args = base_and_args(type_text)
    return args[0] if base in ("varchar", "char") and args else None


def is_orderable(data_type: T.DataType) -> bool:
    """True where MAX and > make sense for a high-water mark."""
    return isinstance(data_type, (T.NumericType, T.StringType, T.DateType, T.TimestampType,
                                  T.TimestampNTZType))
