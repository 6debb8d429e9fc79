"""Encoders, vocabulary operators and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions.columns import clean_tokens, similar_words
from citeloom.operators import learning as ML
from citeloom.operators import relational as R
from citeloom.operators import text as X
from citeloom.plans import sqlparts as S
from citeloom.plans.cleaning import results
from citeloom.plans.registry import Registry
from citeloom.session import checkpointed
from citeloom.session import read_table as t

query = Registry()
QUERIES, ORACLE = query.queries, query.sql

_GOOD = S.good_token("x")
_YEAR = f"case when regexp_full_match(split_part({S.unmarked('pubdate')}, '/', 1), '[0-9]+') then case when try_cast(split_part(pubdate, '/', 1) as int) between 1990 and 2021 then split_part(pubdate, '/', 1) else 'old' end when {S.unmarked('pubdate')} is not null then 'not number' end"
_MISSING = " union ".join(f"select row_id, 'missing', '{c}' from papers_raw where {c} is null or {c} in {S.MARKERS}" for c in ("pages", "vol", "issue"))
FEATURES = f"""title_words as (select row_id as doc_id, unnest(list_filter(string_split(lower(titleid), ' '), lambda x: {_GOOD})) as term from papers_raw), {S.lemma_tables('title_words', 'variants')},
feats as (select * from (
select doc_id, 'title' as field, coalesce(lemma, term) as term from title_words left join variants on variant = term
union select row_id, 'author', lower({S.strip('x')}) from (select row_id, unnest(string_split({S.unmarked('authors')}, ',')) as x from papers_raw)
union select row_id, 'journal', regexp_replace(lower({S.strip(S.unmarked('journal'))}), '[0-9]', '', 'g') from papers_raw
union select row_id, 'publisher', {S.unmarked('publisher')} from papers_raw
union select row_id, 'author_id', unnest(string_split(author_ids, ' ')) from papers_raw join paper_authors using (titleid)
union select row_id, 'year', {_YEAR} from papers_raw
union {_MISSING}) where term is not null),
vocab as (select field, term, count(*) as df from feats group by field, term having count(*) >= case field when 'title' then 20 when 'author' then 2 when 'journal' then 7 when 'publisher' then 5 when 'author_id' then 5 else 1 end)"""


def features(spark, d):
    return X.paper_features(t(spark, d, "papers_raw"), t(spark, d, "paper_authors"))


def _field(name: str, field: str) -> None:
    def f(spark, d):
        long = features(spark, d).where(F.col("field") == field)
        return X.multi_hot(long, X.frequent(long))

    f.__name__ = name
    query(f"with {FEATURES} select doc_id, field || ':' || term as feature from feats join vocab using (field, term) where field = '{field}'")(f)


for _name, _f in (("ml_title", "title"), ("ml_author", "author"), ("ml_journal", "journal"), ("ml_publisher", "publisher"), ("ml_author_id", "author_id"), ("ml_year", "year"), ("ml_page", "missing")):
    _field(_name, _f)


@query(f"with {FEATURES} select doc_id, field || ':' || term as feature from feats join vocab using (field, term)")
def ml_multi_hot(spark, d):
    long = checkpointed(features(spark, d))
    return X.multi_hot(long, X.frequent(long))


@query(f"with {FEATURES} select field, count(*) as n_terms, sum(df)::bigint as n_entries from vocab group by field")
def ml_main(spark, d):
    return X.frequent(features(spark, d)).groupBy("field").agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_entries"))


@query(f"with {FEATURES} select doc_id, count(*) as n_features from feats join vocab using (field, term) group by doc_id")
def ml_process_cols(spark, d):
    return ml_multi_hot(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_features"))


@query("with v as (select publisher, row_number() over (order by publisher) - 1 as hot, count(*) over () as n_columns from (select distinct publisher from papers_raw where publisher is not null)) select row_id, hot, n_columns from papers_raw left join v using (publisher), (select count(distinct publisher) as n from papers_raw) where n_columns is null or n = n_columns")
def ml_get_dummies(spark, d):
    """A column for each value of a field: the place of the one that is set and how many there are; NULL where none is set."""
    p = t(spark, d, "papers_raw").select("row_id", "publisher")
    values = R.row_positions(p.where("publisher is not null").select("publisher").distinct(), [F.asc("publisher")], "hot")
    values = checkpointed(values)
    return p.join(values.withColumn("n_columns", F.lit(values.count()).cast("long")), "publisher", "left").select("row_id", "hot", "n_columns")


@query("select p_partkey, (dense_rank() over (order by p_type) - 1)::double as code from part")
def ml_sparse_dummies(spark, d):
    from pyspark.ml.feature import StringIndexer

    p = t(spark, d, "part").select("p_partkey", "p_type")
    return StringIndexer(inputCol="p_type", outputCol="code", stringOrderType="alphabetAsc", handleInvalid="keep").fit(p).transform(p).select("p_partkey", "code")


@query("select c_custkey, (dense_rank() over (order by c_mktsegment) - 1)::int as hot from customer")
def ml_label_binarizer(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import vector_to_array

    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    model = Pipeline(stages=[StringIndexer(inputCol="c_mktsegment", outputCol="i", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol="i", outputCol="v", dropLast=False)]).fit(c)
    return model.transform(c).select("c_custkey", (F.array_position(vector_to_array("v"), 1.0) - 1).cast("int").alias("hot"))


_TEXT_TOKENS = f"tokens as (select doc_id, t as term from (select doc_id, unnest(string_split(lower(text), ' ')) as t from documents where text is not null) where {S.good_token('t')})"
_HEADS = f"{_TEXT_TOKENS}, {S.lemma_tables('tokens', 'lem')}"


def _text_tokens(spark, d):
    docs = t(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.explode(clean_tokens(F.split(F.lower("text"), " ", -1))).alias("term"))


@query(f"with {_HEADS} select variant, lemma from lem")
def fn_lemma_map(spark, d):
    return X.lemma_map(_text_tokens(spark, d))


@query(f"with {_HEADS} select doc_id, coalesce(lemma, term) as term, count(*) as n from tokens left join lem on lem.variant = tokens.term group by 1, 2")
def fn_apply_lemma(spark, d):
    tokens = checkpointed(_text_tokens(spark, d))
    return X.apply_lemma(tokens, X.lemma_map(tokens)).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"with {_HEADS} select w, lemma, array_to_string(list_transform(list_filter(range(1, least(length(lemma), length(w)) + 1), lambda i: lemma[i] = w[i]), lambda i: lemma[i]), '') as base from w_lem join h_lem using (p)")
def fn_similar_words(spark, d):
    w = _text_tokens(spark, d).select(F.col("term").alias("w")).distinct().where(F.length("w") >= 4).withColumn("p", F.left("w", F.lit(3)))
    pairs = w.join(w.groupBy("p").agg(F.min("w").alias("lemma")), "p")
    return pairs.select("w", "lemma", similar_words(F.col("lemma"), F.col("w"))["base"].alias("base"))


@query(f"with {S.RESULTS}, c as (select (actual > 2)::int as label, count(*) as n from results group by 1), m as (select max(n) as n from c) select label, m.n from c, m")
def ml_oversample(spark, d):
    rows = results(spark, d).select("index1", (F.col("actual") > 2).cast("int").alias("label"))
    return ML.oversample(rows, "label", "index1").groupBy("label").agg(F.count("*").alias("n"))


@query(f"with {S.CLEAN}, r as (select (cites_per_year > 2)::int as label, row_id from clean where date < date '2018-07-01'), c as (select label, count(*) as n from r group by 1), m as (select max(n) as n from c) select label, m.n from c, m")
def ml_oversample_wrap(spark, d):
    """Only the training part is resampled."""
    rows = R.split_by_date(R.clean_papers(t(spark, d, "papers_raw")), "date", "2018-07-01").where("part = 'train'")
    rows = rows.select("row_id", (F.col("cites_per_year") > 2).cast("int").alias("label"))
    return ML.oversample(rows, "label", "row_id").groupBy("label").agg(F.count("*").alias("n"))


@query()
def ml_clf_wrap(spark, d):
    """Resample, fit, and predict the rows as they were."""
    c = _components(spark, d)
    w = ML.resampled_ridge(c, "components", 2, "label", "row_id", 1.0)
    return ML.ridge_score(c, "components", w).select("row_id", (F.col("score") > 0).cast("int").alias("predicted"))


def _papers(spark, d):
    p = R.clean_papers(t(spark, d, "papers_raw")).join(t(spark, d, "paper_authors").select("titleid", "author_ids"), "titleid", "left")
    return p.withColumn("label", (F.col("cites_per_year") > 2).cast("int"))


def _components(spark, d, k=2, first_test=None):
    """Encoded and projected papers, checkpointed as the learners read them many times; encoders and SVD are fitted on those before first_test."""
    papers = checkpointed(_papers(spark, d))
    before = lambda df: df if first_test is None else R.split_by_date(df, "date", first_test).where("part = 'train'").drop("part")
    encoder = ML.fit_encoder(before(papers))
    rows = checkpointed(ML.encode(papers, encoder, ["row_id", "date", "label", "cites_per_year"]))
    _, v = ML.truncated_svd(before(rows), encoder.size, k)
    return checkpointed(ML.project(rows, v))


_GRAM = """e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
g as (select a.i as i, b.i as j, sum(a.x * b.x) as v from e a join e b using (vec_id) group by 1, 2),
g2 as (select a.i as i, b.j as j, sum(a.v * b.v) as v from g a join g b on a.j = b.i group by 1, 2)"""


def _embedding_rows(spark, d):
    return t(spark, d, "embeddings").select(F.sequence(F.lit(0), F.size("embedding") - 1).alias("indices"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))


@query(
    f"""with {_GRAM}, m as (select 1 as power, sum(v) as moment from g where i = j union all select 2, sum(v) from g2 where i = j
 union all select 3, sum(a.v * b.v) from g2 a join g b on a.i = b.j and a.j = b.i) select power, round(pow(moment, 0.5 / power), 6) as norm from m"""
)
def ml_svd(spark, d):
    """Norms of the spectrum of all rows: the sums of the even powers of the singular values are traces of powers of the Gram matrix."""
    s, _ = ML.truncated_svd(_embedding_rows(spark, d), 64, 64)
    return spark.createDataFrame([(p, round(float((s ** (2 * p)).sum() ** (0.5 / p)), 6)) for p in (1, 2, 3)], "power int, norm double")


@query()
def ml_svd_values(spark, d):
    s, _ = ML.truncated_svd(_embedding_rows(spark, d), 64, 10)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "component int, singular_value double")


# Ridge over two plain columns, which SQL can solve as well: the logarithms of the lengths of title and author list.
_XY = f"""{S.CLEAN}, xy as (select row_id, ln(length(titleid) + 1) as x1, ln(coalesce(length(authors), 0) + 1) as x2, case when cites_per_year > 2 then 1e0 else -1e0 end as y from clean)"""


def _solve(rows: str, alpha: str, name: str, by: str = "") -> str:
    """Tables that end in ``name`` (w1, w2, w0): the normal equations with a free constant, by centred sums; ``by`` are columns to group by."""
    group, using = (f"group by {by}", f"{by}, ") if by else ("", "")
    return f"""s_{name} as (select {using}count(*) as n, avg(x1) as m1, avg(x2) as m2, avg(y) as my, covar_pop(x1, x1) * count(*) as c11, covar_pop(x2, x2) * count(*) as c22,
 covar_pop(x1, x2) * count(*) as c12, covar_pop(x1, y) * count(*) as c1y, covar_pop(x2, y) * count(*) as c2y from {rows} {group}),
v_{name} as (select *, ((c22 + {alpha}) * c1y - c12 * c2y) / ((c11 + {alpha}) * (c22 + {alpha}) - c12 * c12) as w1, ((c11 + {alpha}) * c2y - c12 * c1y) / ((c11 + {alpha}) * (c22 + {alpha}) - c12 * c12) as w2 from s_{name}),
{name} as (select {using}w1, w2, my - w1 * m1 - w2 * m2 as w0 from v_{name})"""


def _xy(spark, d):
    p = R.clean_papers(t(spark, d, "papers_raw"))
    x = F.array(*[F.log(F.coalesce(F.length(c), F.lit(0)) + F.lit(1.0)) for c in ("titleid", "authors")])
    return checkpointed(p.select("row_id", x.alias("components"), (F.col("cites_per_year") > 2).cast("int").alias("label")))


@query(f"with {_XY}, {_solve('xy', '1e0', 'w')} select unnest([0, 1, 2]) as term, round(unnest([w1, w2, w0]), 9) as weight from w")
def ml_ridge(spark, d):
    w = ML.ridge_fit(_xy(spark, d), "components", 2, "label", 1.0)
    return spark.createDataFrame([(i, round(float(x), 9)) for i, x in enumerate(w)], "term int, weight double")


_CV = f"""{_XY}, f as (select *, ((row_number() over (partition by y order by row_id) - 1) % 3)::int as fold from xy), g as (select alpha::double as alpha, k::int as k from (values (1), (10), (100), (1000)) a(alpha), range(3) r(k)),
train as (select alpha, k, x1, x2, y from f, g where fold <> k), {_solve('train', 'alpha', 'w', 'alpha, k')},
scored as (select alpha, k, round(w0 + w1 * x1 + w2 * x2, 9) as s, y from f join w on fold = k),
ranked as (select *, rank() over (partition by alpha, k order by s) + (count(*) over (partition by alpha, k, s) - 1) / 2e0 as r from scored)
select alpha, k as fold, round((sum(case when y > 0 then r end) - count(*) filter (y > 0) * (count(*) filter (y > 0) + 1) / 2e0) / (count(*) filter (y > 0) * count(*) filter (y < 0)), 6) as auc from ranked group by 1, 2"""


@query(f"with {_CV}")
def ml_cv_search(spark, d):
    found = ML.cv_search(_xy(spark, d), "components", 2, "label", "row_id")
    return spark.createDataFrame([(a, f, round(auc, 6)) for a, f, auc in found], "alpha double, fold int, auc double")


@query()
def ml_cv_components(spark, d):
    """The same search over the components of all encoded fields."""
    return spark.createDataFrame(ML.cv_search(_components(spark, d), "components", 2, "label", "row_id"), "alpha double, fold int, auc double")


@query()
def ml_pipe_fit(spark, d):
    """Encoders, SVD and ridge on the earlier papers, the rare class resampled; scores of the later papers."""
    c = _split_components(spark, d)
    w = ML.resampled_ridge(c.where("part = 'train'"), "components", 2, "label", "row_id", 10.0)
    return ML.ridge_score(c.where("part = 'test'"), "components", w).select("row_id", "label", (F.col("score") > 0).cast("int").alias("predicted"))


def _predicted(spark, d):
    c = _xy(spark, d)
    return ML.ridge_score(c, "components", ML.ridge_fit(c, "components", 2, "label", 10.0))


_PREDICTED = f"{_XY}, {_solve('xy', '1e1', 'w')}, predicted as (select row_id, y, w0 + w1 * x1 + w2 * x2 as score from xy, w)"


@query(f"with {_PREDICTED} select row_id, round(score, 6) as score from predicted")
def ml_predict(spark, d):
    return _predicted(spark, d).select("row_id", F.round("score", 6).alias("score"))


@query(f"with {_PREDICTED}, c as (select (y > 0)::int as y, (score > 0)::int as p from predicted), {S.METRICS}")
def eval_predictions(spark, d):
    """The metrics of the fitted model's predictions."""
    return R.class_metrics(_predicted(spark, d).select(F.col("label").alias("y"), (F.col("score") > 0).cast("int").alias("p")))


@query(
    f"""with {_PREDICTED}, n as (select round_even(count(*) * 0.05, 0)::bigint as k from clean), a as (select row_id from clean order by cites_per_year desc, row_id limit (select k from n)),
p as (select row_id from predicted order by score desc, row_id limit (select k from n)) select count(*) as n_both, (select count(*) from a) as n_top, count(*)::double / nullif((select count(*) from a), 0) as share from a semi join p using (row_id)"""
)
def eval_overlap(spark, d):
    """How many of the papers cited most are also those predicted highest."""
    rates = R.clean_papers(t(spark, d, "papers_raw")).select("row_id", "cites_per_year")
    return R.quantile_overlap(_predicted(spark, d).select("row_id", "score").join(rates, "row_id"), "score", "cites_per_year", "row_id", 0.05)


def _split_components(spark, d, first_test="2018-07-01"):
    return R.split_by_date(_components(spark, d, first_test=first_test), "date", first_test)


@query()
def ml_gbt_clf(spark, d):
    """Split by date, classes at 10, SVD and trees of the earlier papers with the rare class resampled; the later ones stop the boosting."""
    c = _split_components(spark, d).withColumn("label", (F.col("cites_per_year") > 10).cast("double"))
    train = checkpointed(ML.oversample(c.where("part = 'train'"), "label", "row_id"))
    m = ML.gbt_classifier(train, c.where("part = 'test'"), "components", "label")
    out = m.transform(c.withColumn("features", ML.array_to_vector("components")))
    return out.select("row_id", F.col("prediction").cast("int").alias("predicted"))


@query()
def ml_gbt_reg(spark, d):
    """SVD and trees of the earlier papers; the later ones stop the boosting."""
    c = _split_components(spark, d)
    m = ML.gbt_regressor(c.where("part = 'train'"), c.where("part = 'test'"), "components", "cites_per_year")
    return m.transform(c.withColumn("features", ML.array_to_vector("components"))).select("row_id", F.expm1("prediction").alias("predicted"))


# --- user functions and parallel maps


@query(f"select row_id, lower(titleid) as title from papers_raw")
def udf_row_apply(spark, d):
    return t(spark, d, "papers_raw").select("row_id", F.lower("titleid").alias("title"))


@query("select row_id, length(titleid) as n from papers_raw where titleid is not null")
def udf_parallelize(spark, d):
    def run(batches):
        for b in batches:
            yield b.assign(n=b["titleid"].str.len().astype("int64"))[["row_id", "n"]]

    return t(spark, d, "papers_raw").where("titleid is not null").select("row_id", "titleid").mapInPandas(run, "row_id long, n long")


@query("select distinct unnest(string_split(lower(titleid), ' ')) as term from papers_raw where titleid is not null")
def udf_general_mp(spark, d):
    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"term": sorted({w for x in b["titleid"] for w in x.lower().split(" ")})})

    return t(spark, d, "papers_raw").where("titleid is not null").select("titleid").mapInPandas(run, "term string").distinct()


@query(f"with {S.CLEAN} select row_id, cited_num - cites_per_year as difference from clean")
def udf_dask(spark, d):
    return R.clean_papers(t(spark, d, "papers_raw")).select("row_id", (F.col("cited_num") - F.col("cites_per_year")).alias("difference"))
