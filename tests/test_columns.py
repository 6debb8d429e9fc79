"""Scalar functions on the cases of FIXTURES.md."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from citeloom.functions import columns as C
from citeloom.functions.language import language


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [("2019/7/1", dt.date(2019, 7, 1)), ("2019/7", dt.date(2019, 7, 1)), ("2019", dt.date(2019, 1, 1)), ("2019/13/1", None), ("2019/2/30", None), ("NA", None), ("2019/7/1/5", None), ("", None), (None, None)])
def test_dates(spark, text, want):
    assert one(spark, text, C.parse_date) == want


@pytest.mark.parametrize("text,want", [("Cited by 12", 12), ("NA", 0), ("couldnt find", None), ("Cited by x", None), (None, None), ("", None)])
def test_cited(spark, text, want):
    assert one(spark, text, C.cited_number) == want


def test_rate_on_and_after_the_day(spark):
    rows = [(5, dt.date(2021, 3, 20)), (0, dt.date(2021, 3, 20)), (3, dt.date(2021, 5, 1)), (0, dt.date(2021, 5, 1)), (365, dt.date(2020, 3, 20))]
    got = [r[0] for r in spark.createDataFrame(rows, "n int, d date").coalesce(1).select(C.rate(F.col("n"), C.years_since(F.col("d")))).collect()]
    assert got[0] is None and got[1] is None and got[2] < 0 and got[3] == 0 and got[4] == 365


def test_tokens(spark):
    keep = ["perovskite", "cells:", "2d", "1995", "2021", "co2"]
    drop = ["and", "the", "", "lead-halide", "(ch", "x_y", "c#", "1989", "2022", "3.5", "1e5", "nan", "inf", "infinity", "c60", "5d", "ab"]
    assert one(spark, [*keep, *drop], C.clean_tokens, "array<string>") == keep


@pytest.mark.parametrize("text,want", [("1990", "1990"), ("1989", "old"), ("2022", "old"), ("x", "not number"), (None, None)])
def test_years(spark, text, want):
    assert one(spark, text, C.year_bucket) == want


def test_small_ones(spark):
    assert one(spark, "17th Int. Conf. ", C.clean_journal) == "th int. conf."
    assert [one(spark, float(x), C.rank_bucket, "double") for x in (100, 101, 25, 26, 15, 16, 4, 5)] == [2, 1, 3, 2, 4, 3, 5, 4]
    assert one(spark, "a/b/c", lambda c: C.directory_up(c, 2)) == "a"
    page = "x\nDescription\nA b.\nTotal citations\nTotal citations\nCited by 3"
    assert one(spark, page, C.abstract_between) == "A b.\nTotal citations"
    assert one(spark, "nothing", C.abstract_between) is None
    assert one(spark, 6, C.shape_class, "int") == "circle5"
    r = spark.createDataFrame([(40.0, 20.0), (-1.0, 3.0)], "p double, a double").coalesce(1).select(C.relative_residual(F.col("p"), F.col("a"))).collect()
    assert r[0][0] == 20 / 21 and r[1][0] is None


def test_gradient(spark):
    rows = spark.createDataFrame([(5.0, 1.0), (1.0, 1.0), (1.0, 2.0), (1.0, 0.0), (None, 1.0)], "p double, a double").coalesce(1).select(C.gradient(F.col("p"), F.col("a"))).collect()
    assert [r[0] for r in rows] == [-2.0, 0.0, None, None, None]


TEXTS = [
    ("Growth of films on glass", "en"), ("Über dünne Schichten aus Glas für feuchte Luft", "de"), ("Le rôle de X dans les pérovskites", "fr"), ("Celdas solares de X para aire", "es"), (None, None), ("", "en"),
    ("2D contacts: A REVIEW", "en"), ("DIE ROLLE VON X IN ZELLEN", "de"), ("crecimiento y estabilidad", "es"), ("Η τιμή β είναι υψηλή", "el"), ("β-phase foils", "en"), ("Плёнка растёт", "ru"), ("様子を調べた", "ja"),
    ("效率提高", "zh"), ("박막은 얇다", "ko"), ("هل يبقى ثابتا", "ar"), ("यह पतली है", "hi"), ("ฟิล์มคงรูป", "th"), ("123 +-", "en"), ("the film " * 20_000, "en"),
]


@pytest.mark.parametrize("text,want", TEXTS)
def test_language(spark, text, want):
    assert one(spark, text, language) == want
