"""File sources: nested records, tolerant reads, CSV directories and incremental loads; all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.columns import PAD


def subdirectories(paths: DataFrame, column: str, part: str, extension: str) -> DataFrame:
    """Distinct directories whose name contains ``part``, with the extension of their outputs appended."""
    folder = F.regexp_extract(column, r"^(.*)/[^/]*$", 1)
    return paths.select(folder.alias("dir")).where(F.contains("dir", F.lit(part))).distinct().withColumn("path", F.concat_ws("/", "dir", F.lit(extension)))


def nested_records(df: DataFrame, json: str, schema: T.StructType, key: str) -> DataFrame:
    """Rows of a JSON object of objects: one per key, missing fields padded with the sentinel."""
    parsed = df.select(F.from_json(json, T.MapType(T.StringType(), schema)).alias("m"))
    rows = parsed.select(F.explode("m").alias(key, "v"))
    return rows.select(key, *[F.coalesce(F.col(f"v.{f.name}").cast("string"), F.lit(PAD)).alias(f.name) for f in schema.fields])


def tolerant_json(df: DataFrame, json: str, schema: T.StructType) -> DataFrame:
    """Parsed fields; text that can't be read gives NULL fields and is kept in ``_corrupt``."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return df.withColumn("_j", F.from_json(json, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).select("*", "_j.*").drop("_j")


def read_csv_dir(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_tolerant_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Unreadable files are skipped."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(path)


def rows_to_frame(spark: SparkSession, rows: list[list], schema: T.StructType) -> DataFrame:
    """Rows whose first item is the header."""
    at = [rows[0].index(f.name) for f in schema.fields]
    return spark.createDataFrame([tuple(r[i] for i in at) for r in rows[1:]], schema)
