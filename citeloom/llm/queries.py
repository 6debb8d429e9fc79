"""Queries of this subpackage; each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.format_duplicates import duplicate_rows, format_duplicates
from citeloom.llm.mixing import largest_deviation, mix_texts, share_report
from citeloom.llm.name_variants import name_classes, name_variants
from citeloom.llm.packing import pack_report, pack_texts
from citeloom.llm.sentences import split_sentences
from citeloom.llm.term_frequency import term_frequency
from citeloom.llm.truncation import truncated, truncation_rates
from citeloom.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = term_frequency(read_table(spark, sf_dir, "papers_raw"), "titleid", "row_id")
    return t.where("kind = 'word' and mark is not null").select("term", "mark")


def p1_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequency(read_table(spark, sf_dir, "papers_raw"), "titleid", "row_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    usual = read_table(spark, sf_dir, "journal_list").select("journal_id", "name")
    return name_variants(read_table(spark, sf_dir, "papers_raw").select("scrap_auth_id", "authors", "journal"), usual)


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links as classes with their members."""
    usual = read_table(spark, sf_dir, "journal_list").select("journal_id", "name")
    return name_classes(read_table(spark, sf_dir, "papers_raw").select("scrap_auth_id", "authors", "journal"), usual)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(read_table(spark, sf_dir, "papers_raw"), "description", "row_id", "publisher").where("score > 0").select("row_id")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(read_table(spark, sf_dir, "papers_raw"), "description", "row_id", "publisher")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_rows(read_table(spark, sf_dir, "papers_raw"), "titleid", "row_id")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates(read_table(spark, sf_dir, "papers_raw"), "titleid", "row_id")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pack_sizes"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_report(p6_pack(spark, sf_dir), read_table(spark, sf_dir, "pack_sizes"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_texts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_report(p7_mix(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p7_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is off its share at worst, in blocks."""
    return largest_deviation(p7_mix(spark, sf_dir))


def p7_mix_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_texts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), total="exact")


def p7_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_report(p7_mix_exact(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(read_table(spark, sf_dir, "documents"))


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_sentences(read_table(spark, sf_dir, "documents"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.col("end_char") - F.col("start_char")).alias("longest"))


QUERIES = {f.__name__: f for f in (p1_found, p1_frequency, p2_found, p2_classes, p4_found, p4_rates, p5_found, p5_classes, p6_pack, p6_report, p7_mix, p7_shares, p7_deviation, p7_mix_exact, p7_shares_exact, p8_found, p8_lengths)}
