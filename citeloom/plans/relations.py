"""Joins, aggregates, ordered operators and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import columns as C
from citeloom.operators import relational as R
from citeloom.operators import text as X
from citeloom.plans import sqlparts as S
from citeloom.plans.cleaning import results
from citeloom.plans.registry import Registry
from citeloom.plans.sqlparts import lemma_tables
from citeloom.session import checkpointed
from citeloom.session import read_table as t

query = Registry()
QUERIES, ORACLE = query.queries, query.sql

_PAIRS = "pairs as (select titleid, unnest(string_split(author_ids, ' ')) as author from paper_authors where author_ids is not null)"


def pairs(spark, d):
    return t(spark, d, "paper_authors").where("author_ids is not null").select("titleid", F.explode(F.split("author_ids", " ")).alias("author"))


# --- joins


@query("select p.row_id, coalesce(a.author_ids, 'None') as author_ids from papers_raw p left join paper_authors a using (titleid)")
def jn_left_lookup(spark, d):
    p = t(spark, d, "papers_raw").select("row_id", "titleid")
    return R.left_lookup(p, t(spark, d, "paper_authors"), "titleid", "author_ids", "None").select("row_id", "author_ids")


@query(f"with {S.RESULTS} select p.row_id, p.titleid from papers_raw p where exists (select 1 from results r where r.index1 = p.row_id)")
def jn_semi_keys(spark, d):
    return t(spark, d, "papers_raw").select("row_id", "titleid").join(results(spark, d).select(F.col("index1").alias("row_id")), "row_id", "left_semi")


@query(f"with {S.RESULTS} select p.row_id, p.publisher, r.pred, r.actual from papers_raw p join results r on r.index1 = p.row_id")
def jn_inner_results(spark, d):
    r = results(spark, d).select(F.col("index1").alias("row_id"), "pred", "actual")
    return t(spark, d, "papers_raw").select("row_id", "publisher").join(r, "row_id")


@query(f"with {S.RESULTS}, a as (select index1, pred, actual from results where pred > 3), b as (select index1, pred, actual from results where actual > 3) select * from a natural join b")
def jn_inner_natural(spark, d):
    r = results(spark, d).select("index1", "pred", "actual")
    return r.where("pred > 3").join(r.where("actual > 3"), ["index1", "pred", "actual"])


_TOPIC = f"""{_PAIRS}, hits as (select author, count(distinct titleid) as n_items, count(distinct case when contains(lower(titleid), 'perovskite') then titleid end) as n_hits from pairs group by author),
chosen as (select author, n_items, n_hits, n_hits::double / n_items as share from hits where n_hits::double / n_items > 0.3)"""


def chosen(spark, d):
    return R.topic_share(pairs(spark, d), "author", "titleid", C.contains_any(F.col("titleid"), ["perovskite"]), 0.3)


@query(f"with {_TOPIC} select author, n_items, n_hits, share from chosen")
def agg_topic_share(spark, d):
    return chosen(spark, d)


@query(f"with {_TOPIC} select distinct titleid from pairs where author in (select author from chosen)")
def jn_semi_set(spark, d):
    return pairs(spark, d).join(chosen(spark, d).select("author"), "author", "left_semi").select("titleid").distinct()


@query(f"with {_TOPIC} select p.row_id from papers_raw p where p.titleid in (select titleid from pairs where author in (select author from chosen))")
def flt_in_set_tokens(spark, d):
    titles = pairs(spark, d).join(chosen(spark, d).select("author"), "author", "left_semi").select("titleid").distinct()
    return t(spark, d, "papers_raw").select("row_id", "titleid").join(titles, "titleid", "left_semi").select("row_id")


@query("select titleid, exists (select 1 from papers_raw p where p.titleid = a.titleid)::int as found from paper_authors a")
def jn_exists(spark, d):
    return R.exists_flag(t(spark, d, "paper_authors").select("titleid"), t(spark, d, "papers_raw").select("titleid"), "titleid")


@query("select row_id, titleid from papers_raw p where titleid is not null and not exists (select 1 from paper_authors a where a.titleid = p.titleid)")
def jn_anti_new(spark, d):
    return R.anti_new(t(spark, d, "papers_raw").select("row_id", "titleid").where("titleid is not null"), t(spark, d, "paper_authors"), "titleid")


@query("select row_id, titleid || '|' || coalesce(authors, '') as left_right from (select row_id, titleid from papers_raw) join (select row_id, authors from papers_raw) using (row_id) where titleid is not null")
def jn_horizontal(spark, d):
    p = t(spark, d, "papers_raw")
    return p.select("row_id", "titleid").join(p.select("row_id", "authors"), "row_id").where("titleid is not null").select("row_id", F.concat("titleid", F.lit("|"), F.coalesce("authors", F.lit(""))).alias("left_right"))


@query("select a.author_id, count(distinct p) as n_papers, count(distinct case when k.titleid is not null then p end) as n_topic from (select author_id, unnest(all_papers) as p from author_info) a left join (select distinct titleid from papers_raw where contains(lower(titleid), 'perovskite')) k on k.titleid = a.p group by a.author_id")
def jn_kw_titles(spark, d):
    papers = t(spark, d, "author_info").select("author_id", F.explode("all_papers").alias("titleid"))
    topic = t(spark, d, "papers_raw").where(C.contains_any(F.col("titleid"), ["perovskite"])).select("titleid").distinct().withColumn("hit", F.col("titleid"))
    return papers.join(topic, "titleid", "left").groupBy("author_id").agg(F.countDistinct("titleid").alias("n_papers"), F.countDistinct("hit").alias("n_topic"))


# --- aggregates


@query(f"with {S.TITLE_TOKENS} select distinct term from tokens")
def agg_distinct_tokens(spark, d):
    return title_tokens(spark, d).select("term").distinct()


def title_tokens(spark, d):
    p = t(spark, d, "papers_raw").where("titleid is not null")
    return p.select(F.col("row_id").alias("doc_id"), F.explode(C.clean_tokens(C.split_keep(F.lower("titleid"), " "))).alias("term"))


@query("select distinct a.id as author from (select unnest(authors) as a from graph_papers where contains(lower(title), 'solar') or contains(lower(title), 'photovoltaic')) where a.id <> ''")
def agg_distinct_authors(spark, d):
    g = t(spark, d, "graph_papers").where(C.contains_any(F.col("title"), ["solar", "photovoltaic"]))
    return g.select(F.explode("authors").alias("a")).where("a.id <> ''").select(F.col("a.id").alias("author")).distinct()


@query("select distinct authors[1].id as author from graph_papers where len(authors) > 0 and authors[1].id <> ''")
def agg_first_author(spark, d):
    return t(spark, d, "graph_papers").select(F.try_element_at("authors", F.lit(1)).alias("a")).where("a.id <> ''").select(F.col("a.id").alias("author")).distinct()


@query("select p as titleid, string_agg(author_id, ' ' order by author_id) as author_id from (select author_id, unnest(all_papers) as p from author_info) where p is not null group by p")
def agg_group_concat(spark, d):
    inv = t(spark, d, "author_info").select("author_id", F.explode("all_papers").alias("titleid")).where("titleid is not null")
    return R.group_concat(inv, "titleid", "author_id", ["author_id"])


@query("select scrap_auth_id, titleid, count(*) as n_records, count(distinct _file) as n_files from papers_raw where scrap_auth_id is not null and titleid is not null group by 1, 2")
def agg_collect_papers(spark, d):
    """The papers of each author over all files, in long form: no author is ever gathered in one row."""
    p = t(spark, d, "papers_raw").where("scrap_auth_id is not null and titleid is not null")
    return p.groupBy("scrap_auth_id", "titleid").agg(F.count("*").alias("n_records"), F.countDistinct("_file").alias("n_files"))


@query(f"with {S.TITLE_TOKENS} select term, count(distinct doc_id) as df from tokens group by term")
def agg_doc_freq(spark, d):
    return R.doc_frequency(title_tokens(spark, d), "doc_id", "term")


@query(f"with {S.TITLE_TOKENS} select term, count(distinct doc_id) as df from tokens group by term having count(distinct doc_id) >= 20")
def agg_min_df(spark, d):
    return R.doc_frequency(title_tokens(spark, d), "doc_id", "term", 20)


_COUNTED = ("papers_raw", "author_info", "paper_authors", "graph_papers", "edges", "status_events")


@query(" union all ".join(f"select '{x}' as name, count(*) as n from {x}" for x in _COUNTED))
def agg_unused_count(spark, d):
    """Number of rows of each table."""
    counts = [t(spark, d, x).agg(F.count("*").alias("n")).select(F.lit(x).alias("name"), "n") for x in _COUNTED]
    return reduce(DataFrame.unionByName, counts)


@query(f"with {S.RESULTS} select avg((pred > 2)::int) as positive_rate from results")
def agg_positive_rate(spark, d):
    return results(spark, d).agg(F.avg((F.col("pred") > 2).cast("double")).alias("positive_rate"))


@query(f"with {S.RESULTS}, c as (select (actual > 2)::int as y, (pred > 2)::int as p from results), {S.METRICS}")
def agg_metrics(spark, d):
    return R.class_metrics(results(spark, d).select((F.col("actual") > 2).cast("int").alias("y"), (F.col("pred") > 2).cast("int").alias("p")))


_Q = f"{S.RESULTS}, n as (select round_even(count(*) * 0.05, 0)::bigint as k from results), a as (select index1 from results order by actual desc, index1 limit (select k from n)), p as (select index1 from results order by pred desc, index1 limit (select k from n))"


@query(f"with {_Q} select count(*) as n_both, (select count(*) from a) as n_top, count(*)::double / nullif((select count(*) from a), 0) as share from a semi join p using (index1)")
def agg_quantile_overlap(spark, d):
    return R.quantile_overlap(results(spark, d), "pred", "actual", "index1", 0.05)


_FIELDS = ("title_main", "cited", "authors", "pubdate", "publisher", "vol", "issue", "pages", "description")
_NMISS = " + ".join(f"({c} is null or {c} in {S.MARKERS})::int" for c in _FIELDS)


@query(f"select row_id, {_NMISS} as n_missing, (({_NMISS}) / {len(_FIELDS)}e0 > 0.4)::int as mostly_missing from papers_raw")
def agg_missing_fraction(spark, d):
    return R.missing_fraction(t(spark, d, "papers_raw"), list(_FIELDS)).select("row_id", "n_missing", "mostly_missing")


@query(f"with {S.RESULTS}, r as (select actual - pred as x from results) select least(floor((x + 20) / 0.04e0), 999)::int as bin, count(*) as n from r where x between -20 and 20 group by 1")
def agg_histogram(spark, d):
    return R.histogram(results(spark, d).withColumn("x", F.col("actual") - F.col("pred")), "x", -20.0, 20.0, 1000)


@query(f"with {S.RESULTS} select least(floor(actual / 0.5e0), 39)::int as bin_x, least(floor(pred / 0.5e0), 39)::int as bin_y, count(*) as n from results where actual between 0 and 20 and pred between 0 and 20 group by 1, 2")
def agg_density_2d(spark, d):
    return R.histogram_2d(results(spark, d), "actual", "pred", 0.0, 20.0, 40)


# --- ordered operators


@query("select titleid, row_id from (select *, row_number() over (partition by titleid order by _file, _pos) as rn from papers_raw where titleid is not null) where rn = 1")
def win_dedup_first(spark, d):
    p = t(spark, d, "papers_raw").select("titleid", "row_id", "_file", "_pos").where("titleid is not null")
    return R.dedup_first(p, ["titleid"], ["_file", "_pos"]).select("titleid", "row_id")


@query(f"with {S.CLEAN} select titleid, date, row_number() over (order by date, titleid) - 1 as place from clean")
def win_sort_date(spark, d):
    p = R.clean_papers(t(spark, d, "papers_raw")).select("titleid", "date")
    return R.row_positions(p, [F.asc("date"), F.asc("titleid")], "place")


@query(f"with {S.RESULTS} select index1, pred from results order by pred desc, index1 limit 7")
def win_topk_pred(spark, d):
    return results(spark, d).select("index1", "pred").orderBy(F.desc("pred"), F.asc("index1")).limit(7)


@query(f"with {_Q} select index1 from p")
def win_topq(spark, d):
    return R.top_quantile(results(spark, d), "pred", "index1", 0.05).select("index1")


@query(f"with {S.CLEAN} select row_id, case when date < date '2018-07-01' then 'train' when date is not null then 'test' end as part from clean")
def win_time_split(spark, d):
    return R.split_by_date(R.clean_papers(t(spark, d, "papers_raw")).select("row_id", "date"), "date", "2018-07-01").select("row_id", "part")


@query("select row_id, case when row_number() over (order by row_id) <= 1000 then 'train' else 'test' end as part from papers_raw")
def win_pos_split(spark, d):
    at = R.row_positions(t(spark, d, "papers_raw").select("row_id"), [F.asc("row_id")])
    return at.select("row_id", F.when(F.col("position") < 1000, "train").otherwise("test").alias("part"))


@query(f"with {S.RESULTS}, a as (select index1, actual, row_number() over (order by index1) as i from results), b as (select actual as s, row_number() over (order by md5('11:' || index1::varchar), index1) as i from results) select index1, actual, s as actual_shuffled from a join b using (i)")
def win_shuffle(spark, d):
    return R.shuffled_match(results(spark, d).select("index1", "actual"), "index1", "actual")


@query("select author_id from author_info order by md5('11:' || author_id), author_id limit 1")
def win_random_pick(spark, d):
    return R.sample_one(t(spark, d, "author_info").select("author_id"), "author_id")


@query(f"with {S.RESULTS}, a as (select index1, pred, row_number() over (order by index1) as i from results), b as (select actual as s, row_number() over (order by md5('11:' || index1::varchar), index1) as i from results) select index1, (pred - s) / nullif(least(pred, s) + 1.0, 0) as relative_res from a join b using (i)")
def shuffle_baseline(spark, d):
    r = R.shuffled_match(results(spark, d).select("index1", "pred", "actual"), "index1", "actual")
    return r.select("index1", C.relative_residual(F.col("pred"), F.col("actual_shuffled")).alias("relative_res"))


# --- set operations


@query("select c_custkey as id, c_name as name, c_mktsegment as segment from customer union all select s_suppkey, s_name, null from supplier")
def set_union_all(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("select scrap_auth_id as author from papers_raw where scrap_auth_id is not null union select scrap_auth_id from documents where scrap_auth_id is not null")
def set_union_distinct(spark, d):
    ids = [t(spark, d, n).where("scrap_auth_id is not null").select(F.col("scrap_auth_id").alias("author")) for n in ("papers_raw", "documents")]
    return ids[0].union(ids[1]).distinct()


@query("select coalesce(g.title, p.titleid) as title, coalesce(g.w, 'first') as writer from (select distinct titleid from papers_raw where titleid is not null) p full join (select distinct title, 'second' as w from graph_papers where title is not null) g on g.title = p.titleid")
def set_dict_merge(spark, d):
    a = t(spark, d, "papers_raw").where("titleid is not null").select(F.col("titleid").alias("title")).distinct().withColumn("writer", F.lit("first"))
    b = t(spark, d, "graph_papers").where("title is not null").select("title").distinct().withColumn("writer", F.lit("second"))
    return R.last_writer([a, b], "title")


@query(f"with {S.TITLE_TOKENS}, {lemma_tables('tokens', 'lem')} select distinct term from tokens where term not in (select variant from lem)")
def set_minus_synonyms(spark, d):
    """The vocabulary of the titles without the variants of other words."""
    v = checkpointed(title_tokens(spark, d).select("term").distinct())
    return v.join(X.lemma_map(v).select(F.col("variant").alias("term")), "term", "left_anti")


@query(f"with {_Q} select index1 from a intersect select index1 from p")
def set_intersect_topq(spark, d):
    r = results(spark, d)
    return R.top_quantile(r, "actual", "index1", 0.05).select("index1").intersect(R.top_quantile(r, "pred", "index1", 0.05).select("index1"))


@query("select titleid, list_sort(list_distinct(string_split(author_ids, ' '))) as author_ids from paper_authors where author_ids is not null")
def set_array_distinct(spark, d):
    return t(spark, d, "paper_authors").where("author_ids is not null").select("titleid", F.array_sort(F.array_distinct(F.split("author_ids", " "))).alias("author_ids"))
