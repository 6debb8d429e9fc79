"""Queries of the general corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.split_values import split_values
from citeloom.session import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_values(read_table(spark, sf_dir, "papers_raw"), "authors", ["row_id"], "author")


def p3_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lists have how many values."""
    per = p3_found(spark, sf_dir).groupBy("row_id").agg(F.max("item_no").alias("n_items"))
    return per.groupBy("n_items").agg(F.count("*").alias("n_lists"))


QUERIES = {f.__name__: f for f in (p3_found, p3_list_sizes)}
ORACLE: dict[str, str] = {}
