"""Vocabulary operators: variants of a word and features in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import columns as C
from citeloom.session import checkpointed

#: Endings that make a word a variant of the first word of its prefix group.
ENDINGS = ("s", "ic", "ics", "ed")
#: Least number of documents for a feature of each field.
MIN_DF = {"title": 20, "author": 2, "journal": 7, "publisher": 5, "author_id": 5}


def lemma_map(vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """(variant, lemma): words that differ from the first word with their three-letter start only by an accepted ending."""
    words = vocabulary.select(F.col(term).alias("w")).where(F.length("w") >= 4).distinct().withColumn("_p", F.left("w", F.lit(3)))
    heads = words.groupBy("_p").agg(F.min("w").alias("lemma"))
    pairs = words.join(heads, "_p").where(F.col("w") != F.col("lemma"))
    rest = C.similar_words(F.col("lemma"), F.col("w"))["rest"]
    return pairs.where(rest.isin(*ENDINGS)).select(F.col("w").alias("variant"), "lemma")


def apply_lemma(tokens: DataFrame, lemmas: DataFrame, term: str = "term") -> DataFrame:
    return tokens.join(lemmas.withColumnRenamed("variant", term), term, "left").withColumn(term, F.coalesce("lemma", term)).drop("lemma")


FIELDS = ("title", "author", "journal", "publisher", "author_id", "year", "missing")


def raw_features(papers: DataFrame) -> DataFrame:
    """(doc_id, field, term) of all fields of each paper, titles as they are written; a term twice in one paper counts once.

    papers: row_id, titleid, authors, journal, publisher, author_ids, year, pages, vol, issue.
    """
    fields = F.map_from_arrays(
        F.array(*[F.lit(f) for f in FIELDS]),
        F.array(
            C.clean_tokens(C.split_keep(F.lower("titleid"), " ")),
            F.transform(C.split_keep(C.unmarked(F.col("authors")), ","), lambda x: F.lower(C.strip(x))),
            F.array(C.clean_journal(C.unmarked(F.col("journal")))),
            F.array(C.unmarked(F.col("publisher"))),
            F.split("author_ids", " "),
            F.array(C.year_bucket(F.col("year"))),
            F.filter(F.array(*[F.when(C.missing_flag(F.col(c)) == 1, F.lit(c)) for c in ("pages", "vol", "issue")]), lambda x: x.isNotNull()),
        ),
    )
    long = papers.select(F.col("row_id").alias("doc_id"), F.explode(fields).alias("field", "terms")).select("doc_id", "field", F.explode("terms").alias("term"))
    return long.where("term is not null").distinct()


def title_lemmas(features: DataFrame) -> DataFrame:
    """Variants of the words of the titles."""
    return lemma_map(features.where("field = 'title'"))


def with_lemmas(features: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Features with the variants in titles replaced; those that become equal count once."""
    one = lemmas.select(F.lit("title").alias("field"), F.col("variant").alias("term"), "lemma")
    out = features.join(one, ["field", "term"], "left").select("doc_id", "field", F.coalesce("lemma", "term").alias("term"))
    return out.where("field <> 'title'").unionByName(out.where("field = 'title'").distinct())


def paper_features(papers: DataFrame, authors_of: DataFrame) -> DataFrame:
    """(doc_id, field, term) of all papers, with the lemmas of these papers, before any threshold."""
    p = papers.join(authors_of.select("titleid", "author_ids"), "titleid", "left")
    raw = checkpointed(raw_features(p.withColumn("year", C.year_text(C.unmarked(F.col("pubdate"))))))
    return with_lemmas(raw, title_lemmas(raw))


def frequent(features: DataFrame, thresholds: dict[str, int] = MIN_DF) -> DataFrame:
    """Vocabulary (field, term, df) of the terms in enough documents."""
    least = F.coalesce(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("field")], F.lit(1))
    return features.groupBy("field", "term").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def multi_hot(features: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Present features in long form, (doc_id, feature) with the field as a name space; unseen terms are ignored."""
    kept = features.join(vocabulary.select("field", "term"), ["field", "term"])
    return kept.select("doc_id", F.concat_ws(":", "field", "term").alias("feature"))
