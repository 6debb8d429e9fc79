"""Scalar functions as column expressions; all stay inside the JVM and inside code generation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of missing text, tokens that always stay, symbols that remove a token, stop words, scrape date.
MARKERS = ("NA", "couldnt find", "cant read from scrapper out")
PAD = "cant read from scrapper out"
KEEP_TOKENS = ("1d", "2d", "3d", "4d", *[str(y) for y in range(1990, 2022)])
STOP_TOKENS = ("and", "the", "a", "to", "with", "for", "then", "there", "what", "\n  ", "--", ",", "...")
SYMBOLS = r"[%${}^/\\#*'_()+\-\[\]]"
SCRAPED = dt.date(2021, 3, 20)


def strip(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def unmarked(c: Column) -> Column:
    """NULL for the markers of missing text."""
    return F.when(~c.isin(*MARKERS), c)


def year_text(pub_date: Column) -> Column:
    return F.split(pub_date, "/")[0]


def parse_date(pub_date: Column) -> Column:
    """y/m/d, y/m or y; a missing month or day counts as the first; anything else is NULL."""
    return F.coalesce(*[F.try_to_date(pub_date, f) for f in ("yyyy/M/d", "yyyy/M", "yyyy")])


def cited_number(cited: Column) -> Column:
    """The number in 'Cited by N'; the marker NA means uncited; NULL if it can't be read."""
    return F.when(cited == "NA", F.lit(0)).otherwise(F.try_element_at(F.split(cited, " "), F.lit(3)).try_cast("int"))


def years_since(date: Column, day: dt.date = SCRAPED) -> Column:
    return F.datediff(F.lit(day), date) / F.lit(365.0)


def rate(number: Column, years: Column) -> Column:
    """Number a year; NULL where no time has passed."""
    return F.try_divide(number.cast("double"), years)


def abstract_between(page: Column, start: str = "Description\n", end: str = "\nTotal citations") -> Column:
    """Text between the first start mark and the last end mark; NULL if either is missing."""
    return F.nullif(F.regexp_extract(page, rf"(?s){start}(.*){end}", 1), F.lit(""))


def contains_any(c: Column, keywords: list[str]) -> Column:
    """Any keyword as a part of the text, without regard to case; NULL text contains none."""
    low = F.lower(c)
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(low, F.lit(k.lower()))
    return F.coalesce(hit, F.lit(False))


def matches_any(columns: list[Column], patterns: list[str]) -> Column:
    """Any pattern in any of the columns; NULL never matches."""
    return matches(columns, ["|".join(patterns)]) > 0


def matches(columns: list[Column], patterns: list[str]) -> Column:
    """Number of (column, pattern) pairs that match, without regard to case; NULL never matches."""
    return sum((F.coalesce(c.rlike(f"(?i){p}"), F.lit(False)).cast("int") for c in columns for p in patterns), F.lit(0))


def split_keep(c: Column, sep: str) -> Column:
    """Split that keeps empty tokens; sep is plain text."""
    return F.split(c, "\\Q" + sep + "\\E", -1)


def lower_all(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def is_number_text(c: Column) -> Column:
    """Whether a programming language would read the text as a float; 'nan' and 'inf' count."""
    return F.lower(F.trim(c)).rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$|^[+-]?(nan|inf|infinity)$")


def number_text(c: Column) -> Column:
    return F.when(is_number_text(c), c)


def clean_tokens(tokens: Column) -> Column:
    """Tokens worth a feature: no stop words, symbols, numbers, nor anything with two digits or fewer than three letters."""

    def good(t: Column) -> Column:
        plain = ~t.isin(*STOP_TOKENS) & ~t.rlike(SYMBOLS) & (F.regexp_count(t, F.lit("[0-9]")) <= 1) & ~is_number_text(t) & (F.length(t) >= 3)
        return t.isin(*KEEP_TOKENS) | plain

    return F.filter(tokens, good)


def clean_journal(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), "[0-9]", "")


def year_bucket(c: Column, first: int = 1990, last: int = 2021) -> Column:
    number = F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
    return F.when(number.between(first, last), c).when(c.rlike("^[0-9]+$"), "old").when(c.isNotNull(), "not number")


def missing_flag(c: Column) -> Column:
    return (c.isNull() | c.isin(*MARKERS)).cast("int")


def to_class(c: Column, threshold: float = 10.0) -> Column:
    return (c > threshold).cast("int")


def text_after(c: Column, pattern: str) -> Column:
    """First group of a pattern, NULL if it doesn't match."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def after_nbsp(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(" ")), F.substr(c, F.instr(c, " ") + F.lit(1)))


def query_url(base: str, title: Column) -> Column:
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("+")))


def relative_residual(pred: Column, actual: Column) -> Column:
    return F.try_divide(pred - actual, F.least(pred, actual) + 1.0)


def gradient(pred: Column, actual: Column) -> Column:
    """First derivative of the boosting objective, -sqrt(pred / actual - 1) / actual; NULL below the actual value and where that is 0. The second one is 1."""
    ratio = F.try_divide(pred, actual) - 1
    return F.when(ratio >= 0, F.try_divide(-F.sqrt(ratio), actual))


def rank_bucket(c: Column) -> Column:
    return F.when(c > 100, 1).when(c > 25, 2).when(c > 15, 3).when(c > 4, 4).otherwise(5)


def shape_class(rank: Column) -> Column:
    return F.concat(F.lit("circle"), F.least(rank, F.lit(5)).cast("string"))


def directory_up(path: Column, n: int) -> Column:
    return F.regexp_replace(path, rf"(/[^/]*){{{n}}}$", "")


def last_page(last: Column, page: Column, size: int = 10) -> Column:
    return last * size - size <= page


def similar_words(a: Column, b: Column) -> Column:
    """(base, rest) of two words of at least 4 letters with a common start of at least 3; rest is NULL if b is the shorter one."""
    long, short = F.when(F.length(a) > F.length(b), a).otherwise(b), F.when(F.length(a) > F.length(b), b).otherwise(a)
    n = F.length(short)
    place = F.sequence(F.lit(1), n)
    same = F.filter(place, lambda i: F.substr(short, i, F.lit(1)) == F.substr(long, i, F.lit(1)))
    other = F.filter(place, lambda i: F.substr(short, i, F.lit(1)) != F.substr(long, i, F.lit(1)))
    base = F.array_join(F.transform(same, lambda i: F.substr(short, i, F.lit(1))), "")
    rest = F.concat(F.array_join(F.transform(other, lambda i: F.substr(long, i, F.lit(1))), ""), F.substr(long, n + F.lit(1)))
    ok = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.left(a, F.lit(3)) == F.left(b, F.lit(3)))
    return F.when(ok, F.struct(base.alias("base"), F.when(F.length(b) >= F.length(a), rest).alias("rest")))
