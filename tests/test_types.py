import pytest
from pyspark.sql import types as T

from haulframe.functions.types import (
    contract_type,
    contract_type_of,
    is_orderable,
    max_length,
    spark_type,
    table_type,
)


@pytest.mark.parametrize("native, sizes, expected", [
    ("character varying", (255,), "varchar(255)"),
    ("varchar", (None,), "text"),
    ("nvarchar", (-1,), "text"),
    ("bpchar", (3,), "char(3)"),
    ("char", (0,), "char"),
    ("LongText", (), "text"),
    ("numeric", (None, 10, 2), "numeric(10, 2)"),
    ("numeric", (None, 10, 0), "numeric(10)"),
    ("decimal", (), "numeric"),
    ("money", (), "numeric(19, 4)"),
    ("smallmoney", (), "numeric(10, 4)"),
    ("uint16", (), "integer"),
    ("int64", (), "bigint"),
    ("uint256", (), "bigint"),
    ("hugeint", (), "bigint"),
    ("uint8", (), "smallint"),
    ("int8", (), "tinyint"),
    ("bit", (), "boolean"),
    ("timestamp without time zone", (), "timestamp"),
    ("datetimeoffset", (), "timestamptz"),
    ("date64", (), "date"),
    ("time with time zone", (), "timetz"),
    ("double precision", (), "double"),
    ("real", (), "float"),
    ("uniqueidentifier", (), "uuid"),
    ("jsonb", (), "json"),
    ("image", (), "binary"),
    ("Nullable(Int32)", (), "integer"),
    ("LowCardinality(Nullable(String))", (), "text"),
    ("Nullable(Decimal(10, 2))", (), "numeric(10, 2)"),
    ("FixedString(16)", (), "char(16)"),
    ("decimal(18)", (), "numeric(18)"),
    ("DateTime64(3)", (), "timestamp"),
    ("timestamp[us]", (), "timestamp"),
    ("timestamp[us, tz=UTC]", (), "timestamptz"),
    ("time64[us]", (), "time"),
    ("enum8('a' = 1)", (), "enum"),
    ("long", (), "bigint"),
    ("short", (), "smallint"),
    ("byte", (), "tinyint"),
    ("timestamp_ntz", (), "timestamp"),
    ("FLOAT[]", (), "float[]"),
    ("DECIMAL(10,2)[]", (), "decimal(10,2)[]"),
    ("Array(Int32)", (), "array(int32)"),
    ("interval", (), "interval"),
    (None, (), ""),
])
def test_native_names(native, sizes, expected):
    assert contract_type(native, *sizes) == expected


@pytest.mark.parametrize("name, expected", [
    ("integer", T.IntegerType()), ("int", T.IntegerType()), ("bigint", T.LongType()),
    ("numeric(10, 2)", T.DecimalType(10, 2)), ("numeric(5)", T.DecimalType(5, 0)),
    ("numeric", T.DecimalType(38, 18)), ("varchar(5)", T.StringType()),
    ("timestamp", T.TimestampNTZType()), ("timestamptz", T.TimestampType()),
    ("time", T.StringType()), ("uuid", T.StringType()), ("user-defined", T.StringType()),
    ("float", T.FloatType()), ("array<float>", T.ArrayType(T.FloatType())),
    ("float[]", T.StringType()), ("map(text, int)", T.StringType()),
])
def test_spark_types(spark, name, expected):
    assert spark_type(name) == expected


def test_unknown_type_is_an_error(spark):
    with pytest.raises(ValueError, match="integr"):
        spark_type("integr")


def test_lengths_and_table_types(spark):
    assert max_length("varchar(7)") == 7
    assert max_length("text") is None
    assert max_length("numeric(10, 2)") is None
    assert table_type("varchar(7)") == "VARCHAR(7)"
    assert table_type("char(2)") == "CHAR(2)"
    assert table_type("numeric(10, 2)") == "decimal(10,2)"


def test_spark_fields_keep_declared_length(spark):
    spark.sql("CREATE OR REPLACE TEMP VIEW sized AS SELECT CAST('a' AS VARCHAR(9)) AS v")
    field = T.StructField("v", T.StringType(), True,
                          {"__CHAR_VARCHAR_TYPE_STRING": "varchar(9)"})
    assert contract_type_of(field) == "varchar(9)"
    assert contract_type_of(T.StructField("d", T.DecimalType(10, 2))) == "numeric(10, 2)"
    assert contract_type_of(T.StructField("a", T.ArrayType(T.FloatType()))) == "array<float>"
    assert contract_type_of(T.StructField("z", T.TimestampType())) == "timestamptz"


def test_orderable():
    assert is_orderable(T.TimestampNTZType()) and is_orderable(T.DecimalType(5, 2))
    assert not is_orderable(T.BinaryType()) and not is_orderable(T.ArrayType(T.LongType()))
