"""Projections, derived columns, filters and scalar functions over papers_raw and author_info."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import columns as C
from citeloom.functions.language import language
from citeloom.operators import relational as R
from citeloom.plans import sqlparts as S
from citeloom.plans.registry import Registry
from citeloom.session import read_table as t

query = Registry()
QUERIES, ORACLE = query.queries, query.sql
COLUMNS = [c.strip() for c in S.CLEAN_COLUMNS.split(",")]


@query(f"with {S.CLEAN} select {S.CLEAN_COLUMNS} from clean")
def clean_papers(spark, d):
    return R.clean_papers(t(spark, d, "papers_raw")).select(*COLUMNS)


@query(
    f"""with {S.CLEAN} select titleid, journal, cites_per_year, case when cites_per_year > 100 then 1 when cites_per_year > 25 then 2
 when cites_per_year > 15 then 3 when cites_per_year > 4 then 4 else 5 end as rank from clean order by cites_per_year desc, titleid limit 7"""
)
def top_ranked(spark, d):
    p = R.clean_papers(t(spark, d, "papers_raw"))
    top = p.orderBy(F.desc("cites_per_year"), F.asc("titleid")).limit(7)
    return top.select("titleid", "journal", "cites_per_year", C.rank_bucket(F.col("cites_per_year")).alias("rank"))


@query(f"select row_id, titleid, {S.unmarked('authors')} as authors from papers_raw")
def prj_keep_cols(spark, d):
    return t(spark, d, "papers_raw").select("row_id", "titleid", C.unmarked(F.col("authors")).alias("authors"))


@query("select row_id, map_keys(m) as keys from (select row_id, map_from_entries(list_filter([{'k': 'cited', 'v': cited}, {'k': 'authors', 'v': authors}], lambda e: e.v is not null)) as m from papers_raw)")
def prj_keep_keys(spark, d):
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in ("cited", "authors", "vol", "issue")]), F.array("cited", "authors", "vol", "issue"))
    kept = F.map_filter(m, lambda k, v: k.isin("cited", "authors") & v.isNotNull())
    return t(spark, d, "papers_raw").select("row_id", F.map_keys(kept).alias("keys"))


@query("select author_id, name, rank from author_info")
def prj_drop_cols(spark, d):
    return t(spark, d, "author_info").drop("veremail", "cats", "num_papers", "usa", "sketchy", "all_papers")


@query("select row_id, row_number() over (order by _file, _pos) - 1 as position from papers_raw")
def prj_row_index(spark, d):
    return R.row_positions(t(spark, d, "papers_raw").select("row_id", "_file", "_pos"), [F.asc("_file"), F.asc("_pos")]).select("row_id", "position")


@query("select author_id, num_papers::varchar as num_papers, usa::varchar as usa from author_info")
def prj_cast_str(spark, d):
    return t(spark, d, "author_info").select("author_id", F.col("num_papers").cast("string").alias("num_papers"), F.col("usa").cast("string").alias("usa"))


@query(f"select row_id, split_part({S.unmarked('pubdate')}, '/', 1) as year from papers_raw")
def der_year(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.year_text(C.unmarked(F.col("pubdate"))).alias("year"))


@query(f"select row_id, {S.parse_date('pubdate')} as date from papers_raw")
def der_date(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.parse_date(F.col("pubdate")).alias("date"))


@query(f"select row_id, {S.cited_number('cited')} as cited_num from papers_raw")
def der_cited_num(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.cited_number(F.col("cited")).alias("cited_num"))


@query(f"select row_id, date_diff('day', {S.parse_date('pubdate')}, date '2021-03-20') / 365e0 as years from papers_raw")
def der_years_since(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.years_since(C.parse_date(F.col("pubdate"))).alias("years"))


_RATE = f"{S.cited_number('cited')}::double / nullif(date_diff('day', {S.parse_date('pubdate')}, date '2021-03-20') / 365e0, 0)"


def _rate():
    return C.rate(C.cited_number(F.col("cited")), C.years_since(C.parse_date(F.col("pubdate"))))


@query(f"select row_id, {_RATE} as cites_per_year from papers_raw")
def der_cites_per_year(spark, d):
    return t(spark, d, "papers_raw").select("row_id", _rate().alias("cites_per_year"))


@query(f"select row_id, {S.cited_number('cited')} + 1 as cited_num_mod, ({S.cited_number('cited')} + 1)::double / nullif(date_diff('day', {S.parse_date('pubdate')}, date '2021-03-20') / 365e0, 0) as cites_per_year_mod from papers_raw")
def der_cites_plus1(spark, d):
    n = C.cited_number(F.col("cited")) + 1
    return t(spark, d, "papers_raw").select("row_id", n.alias("cited_num_mod"), C.rate(n, C.years_since(C.parse_date(F.col("pubdate")))).alias("cites_per_year_mod"))


@query(r"select row_id, nullif(regexp_extract(all_text, '(?s)Description\n(.*)\nTotal citations', 1), '') as abstract from papers_raw")
def der_abstract(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.abstract_between(F.col("all_text")).alias("abstract"))


@query(f"with {S.LANGUAGES} select row_id, lang from papers_raw left join languages on text = titleid")
def der_titles_lang(spark, d):
    return t(spark, d, "papers_raw").select("row_id", language(F.col("titleid")).alias("lang"))


@query(f"with {S.LANGUAGES} select row_id from papers_raw join languages on text = titleid where lang = 'en'")
def lang_filter(spark, d):
    return t(spark, d, "papers_raw").where(language(F.col("titleid")) == "en").select("row_id")


@query(f"with {S.languages('documents', 'text')} select lower(d.lang) as lang, l.lang as guess, count(*) as n from documents d join languages l using (text) group by 1, 2")
def lang_detect_agreement(spark, d):
    """Declared languages of the documents against those that the scorer finds."""
    docs = t(spark, d, "documents").where("text is not null")
    return docs.groupBy(F.lower("lang").alias("lang"), language(F.col("text")).alias("guess")).agg(F.count("*").alias("n"))


@query(f"select row_id, r as cites_per_year from (select row_id, {_RATE} as r from papers_raw) where r >= 0")
def flt_cpy_nonneg(spark, d):
    return t(spark, d, "papers_raw").select("row_id", _rate().alias("cites_per_year")).where("cites_per_year >= 0")


@query(f"select row_id from (select row_id, {_RATE} as r from papers_raw) where r is not null and not isinf(r)")
def flt_finite(spark, d):
    r = t(spark, d, "papers_raw").select("row_id", _rate().alias("r"))
    return r.where(F.col("r").isNotNull() & ~F.col("r").isin(float("inf"), float("-inf"))).select("row_id")


@query(f"select row_id from papers_raw where {S.parse_date('pubdate')} < date '2020-04-01'")
def flt_date_before(spark, d):
    return t(spark, d, "papers_raw").where(C.parse_date(F.col("pubdate")) < F.lit("2020-04-01").cast("date")).select("row_id")


@query("select row_id from papers_raw where contains(lower(all_text), 'perovskite') or contains(lower(all_text), 'lead-halide') or contains(lower(all_text), 'mapi')")
def flt_keywords_any(spark, d):
    return t(spark, d, "papers_raw").where(C.contains_any(F.col("all_text"), ["perovskite", "lead-halide", "MAPI"])).select("row_id")


@query("select id from graph_papers where contains(lower(coalesce(abstractwords, '')), 'solar') or contains(lower(coalesce(title, '')), 'solar') or contains(lower(coalesce(abstractwords, '')), 'photovoltaic') or contains(lower(coalesce(title, '')), 'photovoltaic')")
def flt_keywords_df(spark, d):
    words = ["solar", "photovoltaic"]
    return t(spark, d, "graph_papers").where(C.contains_any(F.col("abstractwords"), words) | C.contains_any(F.col("title"), words)).select("id")


@query("select titleid from paper_authors where len(list_distinct(string_split(author_ids, ' '))) > 1")
def flt_multi_author(spark, d):
    return t(spark, d, "paper_authors").where(F.size(F.array_distinct(F.split("author_ids", " "))) > 1).select("titleid")


@query(r"select author_id, regexp_matches(coalesce(veremail, ''), '(?i)\.edu\.|\.ac\.') or regexp_matches(coalesce(rank, ''), '(?i)\.edu\.|\.ac\.') as academic from author_info")
def flt_author_region(spark, d):
    return t(spark, d, "author_info").select("author_id", C.matches_any([F.col("veremail"), F.col("rank")], [r"\.edu\.", r"\.ac\."]).alias("academic"))


@query("select author_id, len(all_papers) > 600 as too_long from author_info")
def flt_author_size(spark, d):
    return t(spark, d, "author_info").select("author_id", F.when(F.col("all_papers").isNotNull(), F.size("all_papers") > 600).alias("too_long"))


@query("select author_id from author_info where usa and not sketchy")
def flt_author_gate(spark, d):
    return t(spark, d, "author_info").where(F.col("usa") & ~F.col("sketchy")).select("author_id")


@query("select row_id, titleid from papers_raw order by _file, _pos limit 300")
def flt_head_n(spark, d):
    return t(spark, d, "papers_raw").select("row_id", "titleid", "_file", "_pos").orderBy("_file", "_pos").limit(300).select("row_id", "titleid")


# --- scalar functions


@query("select row_id, string_split(titleid, ' ') as words, string_split(authors, ',') as names from papers_raw")
def fn_split(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.split_keep(F.col("titleid"), " ").alias("words"), C.split_keep(F.col("authors"), ",").alias("names"))


@query("select row_id, list_transform(string_split(titleid, ' '), lambda x: lower(x)) as words from papers_raw")
def fn_lower_list(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.lower_all(C.split_keep(F.col("titleid"), " ")).alias("words"))


@query(f"select row_id, list_filter(string_split(lower(titleid), ' '), lambda x: {S.good_token('x')}) as words from papers_raw")
def fn_clean_tokens(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.clean_tokens(C.split_keep(F.lower("titleid"), " ")).alias("words"))


@query("select row_id, regexp_replace(lower(" + S.strip("journal") + "), '[0-9]', '', 'g') as journal from papers_raw")
def fn_clean_journal(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.clean_journal(F.col("journal")).alias("journal"))


@query("select row_id, case when regexp_full_match(y, '[0-9]+') then case when try_cast(y as int) between 1990 and 2021 then y else 'old' end when y is not null then 'not number' end as year from (select row_id, split_part(pubdate, '/', 1) as y from papers_raw)")
def fn_clean_year(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.year_bucket(C.year_text(F.col("pubdate"))).alias("year"))


@query("select row_id, " + ", ".join(f"({c} is null or {c} in {S.MARKERS})::int as no_{c}" for c in ("pages", "vol", "issue")) + " from papers_raw")
def fn_missing_flag(spark, d):
    return t(spark, d, "papers_raw").select("row_id", *[C.missing_flag(F.col(c)).alias(f"no_{c}") for c in ("pages", "vol", "issue")])


@query(f"select row_id, (r > 10)::int as label from (select row_id, {_RATE} as r from papers_raw)")
def fn_to_class(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.to_class(_rate()).alias("label"))


@query(f"select row_id, (r > 2)::double as label from (select row_id, {_RATE} as r from papers_raw) where r is not null")
def fn_to_class_tr(spark, d):
    from pyspark.ml.feature import Binarizer

    rows = t(spark, d, "papers_raw").select("row_id", _rate().alias("r")).where("r is not null")
    return Binarizer(threshold=2.0, inputCol="r", outputCol="label").transform(rows).select("row_id", "label")


@query(r"select id, case when regexp_full_match(lower(trim(urlid)), '[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?(nan|inf|infinity)') then urlid end as urlid from graph_papers")
def fn_is_float(spark, d):
    return t(spark, d, "graph_papers").select("id", C.number_text(F.col("urlid")).alias("urlid"))


@query("select id, cited::varchar as cited, urlid as cites from graph_papers where cited is not null and regexp_full_match(urlid, '[0-9]+')")
def fn_text_between(spark, d):
    g = t(spark, d, "graph_papers").where(F.col("cited").isNotNull() & F.col("urlid").rlike("^[0-9]+$"))
    html = F.concat(F.lit("<a href=x?cites="), "urlid", F.lit("&amp;hl=en>Cited by "), F.col("cited").cast("string"), F.lit(" </a>"))
    return g.select("id", C.text_after(html, "Cited by ([0-9]+) ").alias("cited"), C.text_after(html, "cites=([0-9]+)&amp").alias("cites"))


@query("select id, j || ', 2019' as tail from graph_papers where j is not null")
def fn_journal_tail(spark, d):
    g = t(spark, d, "graph_papers").where("j is not null")
    return g.select("id", C.after_nbsp(F.concat(F.lit("A Author, B Author… "), "j", F.lit(", 2019"))).alias("tail"))


@query("select id, 'https://example.org/search?q=' || replace(title, ' ', '+') as url from graph_papers")
def fn_url_build(spark, d):
    return t(spark, d, "graph_papers").select("id", C.query_url("https://example.org/search?q=", F.col("title")).alias("url"))


@query("select row_id, split_part(_file, '/', 1) as folder from papers_raw")
def fn_dirname_up(spark, d):
    return t(spark, d, "papers_raw").select("row_id", C.directory_up(F.col("_file"), 1).alias("folder"))


@query("select id, ceil(cited / 10.0)::int * 10 - 10 <= 20 as last_page from graph_papers where cited is not null")
def fn_page_last(spark, d):
    g = t(spark, d, "graph_papers").where("cited is not null")
    return g.select("id", C.last_page(F.ceil(F.col("cited") / 10).cast("int"), F.lit(20)).alias("last_page"))


@query("select row_id, map_keys(map_from_entries(list_filter([{'k': 'vol', 'v': vol}, {'k': 'issue', 'v': issue}, {'k': 'pages', 'v': pages}], lambda e: e.v not in ('NA', 'couldnt find', 'cant read from scrapper out')))) as fields from papers_raw")
def fn_set_remove(spark, d):
    m = F.map_from_arrays(F.array(F.lit("vol"), F.lit("issue"), F.lit("pages")), F.array("vol", "issue", "pages"))
    return t(spark, d, "papers_raw").select("row_id", F.map_keys(F.map_filter(m, lambda k, v: ~v.isin(*C.MARKERS))).alias("fields"))


@query(f"with {S.RESULTS} select index1, actual - pred as residual from results")
def fn_residual(spark, d):
    return results(spark, d).select("index1", (F.col("actual") - F.col("pred")).alias("residual"))


@query(f"with {S.RESULTS} select index1, (actual - pred) / nullif(actual, 0) as norm_res from results")
def fn_norm_res(spark, d):
    return results(spark, d).select("index1", F.try_divide(F.col("actual") - F.col("pred"), F.col("actual")).alias("norm_res"))


@query(f"with {S.RESULTS} select index1, (pred - actual) / nullif(least(pred, actual) + 1.0, 0) as relative_res from results")
def fn_relative_res(spark, d):
    return results(spark, d).select("index1", C.relative_residual(F.col("pred"), F.col("actual")).alias("relative_res"))


@query(f"with {S.RESULTS} select index1, case when actual <> 0 and pred >= actual then -sqrt(pred / actual - 1) / actual end as gradient, 1e0 as hessian from results")
def ml_custom_obj(spark, d):
    """Derivatives of the boosting objective for each prediction."""
    return results(spark, d).select("index1", C.gradient(F.col("pred"), F.col("actual")).alias("gradient"), F.lit(1.0).alias("hessian"))


@query(f"with {S.RESULTS} select index1, case when actual > 100 then 1 when actual > 25 then 2 when actual > 15 then 3 when actual > 4 then 4 else 5 end as rank from results")
def fn_rank_bucket(spark, d):
    return results(spark, d).select("index1", C.rank_bucket(F.col("actual")).alias("rank"))


@query(f"with {S.RESULTS} select index1, row_number() over (order by pred desc, index1) as place from results")
def fn_rank_pos(spark, d):
    return R.row_positions(results(spark, d).select("index1", "pred"), [F.desc("pred"), F.asc("index1")]).select("index1", (F.col("position") + 1).alias("place"))


@query(f"with {S.RESULTS} select index1, '  ' || titleid as title, 'Journal:  ' || coalesce(journal, '') as journal_line, 'Authors:  ' || coalesce(authors, '') as author_line, 'circle' || least(case when actual > 100 then 1 when actual > 25 then 2 when actual > 15 then 3 when actual > 4 then 4 else 6 end, 5) as shape from results")
def fn_ui_labels(spark, d):
    line = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("")))
    return results(spark, d).select("index1", F.concat(F.lit("  "), "titleid").alias("title"), line("Journal:  ", "journal").alias("journal_line"), line("Authors:  ", "authors").alias("author_line"), C.shape_class(C.rank_bucket(F.col("actual"))).alias("shape"))


def results(spark, d):
    """Rates with a fixed distortion as predictions, keyed by row_id."""
    p = R.clean_papers(t(spark, d, "papers_raw"))
    pred = F.col("cites_per_year") * (F.lit(0.5) + ((F.col("row_id") * 7919) % 1000) / F.lit(1000.0))
    return p.select(F.col("row_id").alias("index1"), "titleid", "journal", "authors", pred.alias("pred"), F.col("cites_per_year").alias("actual"))
