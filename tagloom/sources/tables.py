"""Tables in and out. The connector is an argument; Spark does the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.schemas import DICTIONARY, MAPPING


def read(spark: SparkSession, source: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """A table from any Spark source: files by path, ``table`` by catalog name, ``jdbc`` by its options."""
    if fmt == "table":
        return spark.table(source)
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("dbtable", source).load() if fmt == "jdbc" else reader.load(source)


def read_dictionary(spark: SparkSession, source: str, fmt: str = "parquet", **options) -> DataFrame:
    """Dictionary rows as stored. JSON files get the schema so that absent fields read as null."""
    stored = T.StructType([T.StructField("row_seq", T.LongType()), *DICTIONARY.fields])
    return read(spark, source, fmt, stored if fmt == "json" else None, **options)


def read_mapping(spark: SparkSession, source: str, fmt: str = "parquet", **options) -> DataFrame:
    """Mapping rows; a text format without types gets them from the schema.

    CSV has no way to tell an empty text from an absent one, and in the mapping an empty indicator is the
    normal case, so there they are read as empty.
    """
    rows = read(spark, source, fmt, MAPPING if fmt in ("json", "csv") else None, **options)
    return rows.fillna("") if fmt == "csv" else rows


def save_version(table: DataFrame, base: str, version: int) -> str:
    """Write the next state of a table beside the present one, never over files it was computed from."""
    path = f"{base}/version={version}"
    table.write.mode("errorifexists").parquet(path)
    return path


def load_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """One version of a table, the newest by default."""
    if version is None:
        version = spark.read.parquet(base).agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{base}/version={version}")
