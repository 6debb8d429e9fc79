"""Sources and sinks as relations: what they read or write, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import columns as C
from citeloom.operators import relational as R
from citeloom.operators.learning import encode, fit_encoder
from citeloom.operators.state import latest_state, status_code
from citeloom.plans import sqlparts as S
from citeloom.plans.features import FEATURES
from citeloom.plans.registry import Registry
from citeloom.session import bounded_rows
from citeloom.session import read_table as t
from citeloom.sinks import files as K
from citeloom.sources import files as L
from citeloom.sources import markup as M
from citeloom.streaming import ingest as I

query = Registry()
QUERIES, ORACLE = query.queries, query.sql

NATION = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.IntegerType())])


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _pages(spark, d):
    """A result page per graph paper, as the crawler would have seen it."""
    g = t(spark, d, "graph_papers").where("title is not null")
    cited = F.coalesce(F.concat(F.lit('<a href="/scholar?cites='), F.coalesce("urlid", F.lit("")), F.lit('&amp;hl=en">Cited by '), F.col("cited").cast("string"), F.lit(" </a>")), F.lit(""))
    html = F.concat(F.lit('<html><body><div class="gs_r gs_or gs_scl"><h3 class="gs_rt">'), _escaped(F.col("title")), F.lit('</h3><div><div>Journal</div><div>'), _escaped(F.coalesce("j", F.lit(""))), F.lit("</div></div>"), cited, F.lit("<br></div><!-- <h3 class='gs_rt'>no</h3> --></body></html>"))
    return g.select("id", html.alias("page"))


@query("select distinct split_part(_file, '/', 1) as dir, split_part(_file, '/', 1) || '/outputs' as path from papers_raw where contains(_file, 'worker')")
def src_list_dirs(spark, d):
    return L.subdirectories(t(spark, d, "papers_raw").select("_file"), "_file", "worker", "outputs")


@query("select row_id::varchar as row_id, coalesce(titleid, 'cant read from scrapper out') as titleid, coalesce(cited, 'cant read from scrapper out') as cited, coalesce(book, 'cant read from scrapper out') as book from papers_raw")
def src_nested_dicts(spark, d):
    fields = T.StructType([T.StructField(n, T.StringType()) for n in ("titleid", "cited", "book")])
    p = t(spark, d, "papers_raw")
    json = F.to_json(F.create_map(F.col("row_id").cast("string"), F.struct("titleid", "cited", "book")))
    return L.nested_records(p.select(json.alias("json")), "json", fields, "row_id")


@query("select event_type, count(*) as n from events group by event_type")
def src_incremental(spark, d):
    return I.ingest_table(spark, f"{d}/events.parquet", "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"select row_id, titleid, {S.unmarked('description')} as description from papers_raw where contains(lower(description), 'copper') or contains(lower(titleid), 'perovskite')")
def src_filtered_dicts(spark, d):
    hit = C.contains_any(F.col("description"), ["copper"]) | C.contains_any(F.col("titleid"), ["perovskite"])
    return t(spark, d, "papers_raw").where(hit).select("row_id", "titleid", C.unmarked(F.col("description")).alias("description"))


@query("select event_id, case when event_id % 10 <> 0 then (props->>'k')::int end as k, event_id % 10 = 0 as bad from events")
def src_tolerant_pickle(spark, d):
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("props"))
    return L.tolerant_json(e, "props", T.StructType([T.StructField("k", T.IntegerType())])).select("event_id", "k", F.col("_corrupt").isNotNull().alias("bad"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def src_csv_dir(spark, d):
    path = K.shared_path(spark, "csv")
    K.write_csv(t(spark, d, "nation").repartition(3), path)
    return L.read_csv_dir(spark, path, NATION)


@query("select n_regionkey, count(*) as n from nation group by 1")
def src_csv(spark, d):
    path = K.shared_path(spark, "csv")
    K.write_csv(t(spark, d, "nation").coalesce(1), path)
    return L.read_csv_dir(spark, path, NATION).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("select r_regionkey, r_name from region")
def src_pickle(spark, d):
    return L.read_tolerant_parquet(spark, f"{d}/region.parquet").select("r_regionkey", "r_name")


@query("select r_name, r_regionkey from region")
def src_rows_to_frame(spark, d):
    rows = [["r_name", "r_regionkey"], *[[r["r_name"], r["r_regionkey"]] for r in bounded_rows(t(spark, d, "region"), 1000, "region")]]
    return L.rows_to_frame(spark, rows, T.StructType([T.StructField("r_name", T.StringType()), T.StructField("r_regionkey", T.IntegerType())]))


@query("select distinct id from status_events where lower(status) = 'false' and id is not null order by id limit 20")
def src_sql_select(spark, d):
    return t(spark, d, "status_events").where((F.lower("status") == "false") & F.col("id").isNotNull()).select("id").distinct().orderBy("id").limit(20)


@query("select id, case when cited is not null then cited end as cited, case when cited is not null and regexp_full_match(urlid, '[0-9]+') then urlid end as cites from graph_papers where title is not null")
def src_html_papers(spark, d):
    p = _pages(spark, d)
    return p.select("id", C.text_after(F.col("page"), "Cited by ([0-9]+) ").try_cast("int").alias("cited"), C.text_after(F.col("page"), "cites=([0-9]+)&amp;").alias("cites"))


@query("select id, coalesce(j, '') as journal, null::varchar as volume from graph_papers where title is not null")
def src_html_field(spark, d):
    return M.extract_fields(_pages(spark, d), "id", "page", {"journal": ["Source", "Journal"], "volume": ["Volume"]})


@query("select id, 0 as node_no, title as text from graph_papers where title is not null")
def src_html_find(spark, d):
    return M.extract_nodes(_pages(spark, d), "id", "page", "class", "gs_rt")


def _mails(spark, d):
    subject = F.when(F.col("event_id") % 3 == 0, F.lit("Perovskite solar - new results")).when(F.col("event_id") % 3 == 1, F.lit("perovskite solar - new results")).otherwise("Other")
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    html = F.concat(F.lit('<p><a href="http://scholar.google.com/scholar_url?url=x">'), "event_type", F.lit(' ÿ?>~</a> <a href="http://example.org/">no</a></p>'))
    html = F.replace(html, F.lit("?>~"), F.lit("? ~"))
    body = F.translate(F.base64(F.encode(html, "UTF-8")), "+/\r\n", "-_")
    return t(spark, d, "events").select("event_id", F.array(header("From", F.lit("a@example.org")), header("Subject", subject)).alias("headers"), body.alias("body"))


@query("select event_id from events where event_id % 3 = 0")
def src_email_list(spark, d):
    return _mails(spark, d).where(M.mail_subject_is(F.col("headers"), "Perovskite solar - new results")).select("event_id")


@query("""select event_id, '<p><a href="http://scholar.google.com/scholar_url?url=x">' || event_type || ' ÿ? ~</a> <a href="http://example.org/">no</a></p>' as html from events""")
def src_email_body(spark, d):
    return _mails(spark, d).select("event_id", M.mail_body(F.col("body")).alias("html"))


@query("select event_id, event_type || ' ÿ? ~' as title from events")
def src_email_links(spark, d):
    return _mails(spark, d).select("event_id", F.explode(M.link_texts(M.mail_body(F.col("body")), "http://scholar.google.com/scholar_url?url")).alias("title"))


@query("select author_id, name, rank, veremail, len(list_distinct(cats)) as n_cats from author_info")
def src_author_page(spark, d):
    return t(spark, d, "author_info").select("author_id", "name", "rank", "veremail", F.when(F.col("cats").isNotNull(), F.size(F.array_distinct(F.filter("cats", lambda x: x.isNotNull()))).cast("long")).alias("n_cats"))


@query("select id, title from graph_papers g where title is not null and not exists (select 1 from papers_raw p where p.titleid = g.title)")
def src_unseen_titles(spark, d):
    g = t(spark, d, "graph_papers").where("title is not null").select("id", "title")
    return R.anti_new(g, t(spark, d, "papers_raw").select(F.col("titleid").alias("title")), "title")


@query(f"with {S.CLEAN.replace('from papers_raw where titleid is not null', 'from papers_raw where titleid is not null and contains(_file, $$late$$)')} select {S.CLEAN_COLUMNS} from clean")
def src_email_papers(spark, d):
    late = t(spark, d, "papers_raw").where(F.contains("_file", F.lit("late")))
    return R.clean_papers(late).select(*[c.strip() for c in S.CLEAN_COLUMNS.split(",")])


@query("select id from (select id, 'page ' || case when status = '404' then 'Error 404' else 'ok' end as page from status_events where id is not null) where not contains(page, 'Error 404')")
def src_404(spark, d):
    s = t(spark, d, "status_events").where("id is not null")
    page = F.concat(F.lit("page "), F.when(F.col("status") == "404", "Error 404").otherwise("ok"))
    return s.where(M.page_ok(page)).select("id")


@query("select r_regionkey, r_name from region")
def snk_csv(spark, d):
    path = K.shared_path(spark, "run")
    K.write_csv(t(spark, d, "region"), path)
    return L.read_csv_dir(spark, path, T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("r_name", T.StringType())]))


@query("select author_id, all_papers from author_info")
def snk_pickle(spark, d):
    path = K.shared_path(spark, "authors")
    t(spark, d, "author_info").select("author_id", "all_papers").write.parquet(path)
    return spark.read.parquet(path)


@query("select true as bounded, count(*) as n from papers_raw")
def snk_batch_flush(spark, d):
    path = K.shared_path(spark, "batches")
    K.write_batches(t(spark, d, "papers_raw").select("row_id"), path, 2000)
    per = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return per.agg((F.max("n") <= 2000).alias("bounded"), F.sum("n").alias("n"))


@query("select id, writer from (select author_id as id, 'stored' as writer from author_info union all select distinct id, 'new' from (select a.id from (select unnest(authors) as a from graph_papers)) where id <> '' and id not in (select author_id from author_info))")
def snk_db_insert(spark, d):
    stored = t(spark, d, "author_info").select(F.col("author_id").alias("id"), F.lit("stored").alias("writer"))
    new = t(spark, d, "graph_papers").select(F.explode("authors").alias("a")).where("a.id <> ''").select(F.col("a.id").alias("id"), F.lit("new").alias("writer"))
    return K.insert_absent(stored, new, "id")


_LATEST = "latest as (select id, status, ts from (select *, row_number() over (partition by id order by ts desc nulls last, loaded_at desc nulls last, status desc nulls last) as rn from status_events where id is not null) where rn = 1)"
_CODE = "case when lower(status) in ('1', 'true') then 'done' when lower(status) in ('0', 'false') then 'open' when status = '404' then 'gone' when status is not null then 'unknown' end"


@query(f"with {_LATEST} select l.id, case when a.author_id is not null then 'done' else {_CODE} end as state from latest l left join (select author_id from author_info where sketchy) a on a.author_id = l.id")
def snk_db_update(spark, d):
    log = t(spark, d, "status_events")
    batch = t(spark, d, "author_info").where("sketchy").select(F.col("author_id").alias("id"), F.lit("1").alias("status"), F.lit("2999-01-01").cast("timestamp_ntz").alias("ts"), F.lit("2999-01-01").cast("timestamp_ntz").alias("loaded_at"))
    batch = batch.join(log.select("id"), "id", "left_semi")
    last = latest_state(log.unionByName(batch), "id", "status", "ts", "loaded_at")
    return last.select("id", status_code(F.col("status")).alias("state"))


@query("select t.name, c.place::int as place, c.name as column_name, 0::bigint as n from (values ('papers', 2), ('authors', 3), ('firstauthors', 3), ('authorpapers', 2), ('solarauthors', 3)) t(name, n), (values (0, 'id'), (1, 'value'), (2, 'scrapped')) c(place, name) where c.place < t.n")
def snk_ddl(spark, d):
    """The tables of the crawlers, created twice; their columns, and that they are empty."""
    path = K.shared_path(spark, "tables")
    prefix = "t_" + path.rsplit("-", 1)[1] + "_"
    for _ in range(2):
        names = K.create_tables(spark, path, prefix)
    rows = [(n[len(prefix) :].lower(), i, c, n) for n in names for i, c in enumerate(spark.table(n).columns)]
    counts = {n: spark.table(n).count() for n in names}
    return spark.createDataFrame([(name, i, c, counts[n]) for name, i, c, n in rows], "name string, place int, column_name string, n long")


@query("select * from region")
def snk_db_dump(spark, d):
    return t(spark, d, "region")


@query(f"with {S.RESULTS} select json_extract_string(json_object('title', titleid, 'rank', case when actual > 100 then 1 when actual > 25 then 2 when actual > 15 then 3 when actual > 4 then 4 else 5 end), '$.title') as title, pred from results order by pred desc, index1 limit 7")
def snk_ui(spark, d):
    from citeloom.plans.cleaning import results

    top = results(spark, d).orderBy(F.desc("pred"), F.asc("index1")).limit(7)
    json = F.to_json(F.struct(F.col("titleid").alias("title"), C.rank_bucket(F.col("actual")).alias("rank")))
    return top.select(F.get_json_object(json, "$.title").alias("title"), "pred")


@query("select event_id, length('<p><a href=\"http://scholar.google.com/scholar_url?url=x\">' || event_type || ' ÿ? ~</a> <a href=\"http://example.org/\">no</a></p>') as n from events")
def snk_html_pages(spark, d):
    path = K.shared_path(spark, "pages")
    _mails(spark, d).select("event_id", M.mail_body(F.col("body")).alias("html")).write.parquet(path)
    return spark.read.parquet(path).select("event_id", F.length("html").cast("long").alias("n"))


@query(
    f"""with {FEATURES}, m as (select doc_id, field || ':' || term as name from feats join vocab using (field, term))
select p.row_id, ({S.cited_number('cited')} > 10)::int as label, count(name) as nnz, min(name) as first_name, max(name) as last_name from papers_raw p left join m on doc_id = row_id group by 1, 2"""
)
def snk_sparse_npz(spark, d):
    """The encoded papers as a sparse matrix with ids, labels and names of the columns, written and read back."""
    p = t(spark, d, "papers_raw").join(t(spark, d, "paper_authors").select("titleid", "author_ids"), "titleid", "left")
    p = p.withColumns({"year": C.year_text(C.unmarked(F.col("pubdate"))), "label": C.to_class(C.cited_number(F.col("cited")))})
    encoder = fit_encoder(p)
    path = K.shared_path(spark, "matrix")
    K.write_sparse(encode(p, encoder, ["row_id", "label"]), encoder.vocabulary, path)
    rows, names = K.read_sparse(spark, path)
    long = rows.select("row_id", F.explode("indices").alias("index")).join(names, "index")
    per = long.groupBy("row_id").agg(F.count("*").alias("nnz"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))
    return rows.select("row_id", "label").join(per, "row_id", "left").withColumn("nnz", F.coalesce("nnz", F.lit(0).cast("long")))
