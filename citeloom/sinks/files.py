"""Sinks: run-stamped files, batches of bounded size, tables, insert-if-absent and state updates as appended events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import shared_folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_batches(df: DataFrame, path: str, most: int) -> None:
    """Files of at most ``most`` rows each."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", most).parquet(path)


def insert_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The stored rows and those new ones whose key is absent; of new rows with one key the least stays."""
    rest = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return stored.unionByName(once.join(stored.select(key), key, "left_anti"))


# The tables of the crawlers and their columns.
_WORK = "id STRING NOT NULL, value STRING, scrapped STRING"
_STORE = "id STRING NOT NULL, value STRING"
TABLES = {"papers": _STORE, "authors": _WORK, "firstauthors": _WORK, "authorpapers": _STORE, "solarAuthors": _WORK}


def create_tables(spark: SparkSession, path: str, prefix: str = "", tables: dict[str, str] = TABLES) -> list[str]:
    """Creates what is absent of the tables, each in its own folder below the path; their names."""
    for name, columns in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet LOCATION '{path}/{name}'")
    return [prefix + name for name in tables]


def write_sparse(rows: DataFrame, vocabulary: DataFrame, path: str) -> None:
    """A sparse matrix in two tables: rows with id, label and the places and values that are set, and the name of each column."""
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    vocabulary.select("index", F.concat_ws(":", "field", "term").alias("name")).write.mode("errorifexists").parquet(f"{path}/names")


def read_sparse(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, names) of a sparse matrix."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/names")
