"""File sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Doubled quotes stand for a quote inside a quoted field.
_CSV = {"header": True, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             timestamp_format: str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header, as the columns of the schema by name, in any order in the file.

    A missing column is an error. A value that its column's type can't hold becomes null.
    ``timestamp_format`` is how timestamps are written. Quoted records may hold line breaks;
    a file that has none is read in parts with ``multi_line=False``, and one that has some with
    ``split_csv.read_csv_strings`` and ``typed_columns``.
    """
    return typed_columns(read_csv_strings(spark, path, multi_line), schema, timestamp_format)


def typed_columns(strings: DataFrame, schema: T.StructType,
                  timestamp_format: str | None = None) -> DataFrame:
    """The schema's columns of a table of strings, by name."""
    df = require_columns(strings, schema.names)

    def typed(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if timestamp_format and isinstance(field.dataType, T.TimestampType):
            return F.try_to_timestamp(column, F.lit(timestamp_format)).alias(field.name)
        return column.try_cast(field.dataType).alias(field.name)

    return df.select(*[typed(field) for field in schema.fields])


def read_csv_strings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with every column as a string, named by the header; a BOM is dropped."""
    df = spark.read.options(
        **_CSV, multiLine=multi_line, inferSchema=False, encoding="UTF-8").csv(path)
    return df.toDF(*[name.lstrip("\ufeff").strip('"') for name in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; white space at the ends of a text is part of it."""
    df.write.mode(mode).options(
        header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; text outside ASCII stays as it is."""
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Parquet between stages, partitioned by ``by`` when given."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet table that may not exist yet; then an empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def ensure_string_columns(df: DataFrame, columns) -> DataFrame:
    """The named columns as strings, empty where the table lacks them."""
    return df.withColumns({
        name: F.col(name).cast("string") if name in df.columns else F.lit("")
        for name in columns
    })
