"""Graph walks, stateful operators and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import columns as C
from citeloom.functions.language import language
from citeloom.operators import graph as G
from citeloom.operators import state as Z
from citeloom.plans import sqlparts as S
from citeloom.plans.edges import _CODE, _LATEST
from citeloom.plans.registry import Registry
from citeloom.session import read_table as t
from citeloom.streaming import ingest as I

query = Registry()
QUERIES, ORACLE = query.queries, query.sql

_DEPTH = 40  # of the recursive SQL; deeper than any of these graphs
_NUMERIC = r"regexp_full_match(lower(trim(urlid)), '[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?(nan|inf|infinity)')"
_E = "e as (select distinct cited_id, citing_id from edges where cited_id is not null and citing_id is not null), s as (select min(cited_id) as id from e)"


def _start(spark, d):
    return t(spark, d, "edges").agg(F.min("cited_id").alias("id"))


@query(f"with recursive {_E}, walk as (select id, 0 as level from s union select e.citing_id, level + 1 from walk join e on e.cited_id = walk.id where level < {_DEPTH}) select id, min(level) as level from walk group by id")
def gr_bfs(spark, d):
    return G.bfs_levels(t(spark, d, "edges"), _start(spark, d))


@query("select cited_id, citing_id from edges where cited_id in (select id from graph_papers where cited > 10) group by 1, 2")
def gr_expand(spark, d):
    hot = t(spark, d, "graph_papers").where("cited > 10").select(F.col("id").alias("cited_id"))
    return t(spark, d, "edges").join(hot, "cited_id", "left_semi").distinct()


@query(
    f"""with recursive {_E}, x as (select id from graph_papers where cited > 2 and {_NUMERIC}),
walk as (select id, 0 as level from s union select e.citing_id, level + 1 from walk join e on e.cited_id = walk.id where level < {_DEPTH} and (level = 0 or walk.id in (select id from x)))
select id, min(level) as level from walk group by id"""
)
def gr_leaf_prune(spark, d):
    return G.bfs_levels(t(spark, d, "edges"), _start(spark, d), G.expandable(t(spark, d, "graph_papers")))


def _unrolled(levels: int, limit: float) -> str:
    """The walk with pruning, one set of tables a level."""
    parts = [f"with {_E}", "n0 as (select id, true as go, 0 as level from s)"]
    for k in range(1, levels + 1):
        seen = " union all ".join(f"select id from n{j}" for j in range(k))
        parts += [
            f"r{k} as materialized (select e.cited_id, e.citing_id, e.citing_id in ({seen}) as old from e join n{k - 1} on id = cited_id where go)",
            f"f{k} as materialized (select citing_id, min(cited_id) as parent from r{k} where not old group by 1)",
            f"p{k} as (select cited_id, count(*) as n, (select count(*) from f{k} where parent = cited_id) as fresh from r{k} group by 1)",
            f"n{k} as materialized (select citing_id as id, coalesce((n - fresh)::double / n < {limit}, false) as go, {k} as level from f{k} left join p{k} on cited_id = parent)",
        ]
    return ", ".join(parts) + " " + " union all ".join(f"select id, level from n{k}" for k in range(levels + 1))


@query(_unrolled(_DEPTH, 0.9))
def gr_revisit_prune(spark, d):
    return G.bfs_levels(t(spark, d, "edges"), _start(spark, d), None, 0.9)


@query("select id from graph_papers g where not exists (select 1 from edges e where e.cited_id = g.id or e.citing_id = g.id)")
def gr_visited(spark, d):
    e = t(spark, d, "edges")
    seen = e.select(F.col("cited_id").alias("id")).union(e.select("citing_id")).distinct()
    return t(spark, d, "graph_papers").select("id").join(seen, "id", "left_anti")


@query("select cited_id, row_number() over (partition by cited_id order by citing_id) - 1 as position, citing_id from (select distinct cited_id, citing_id from edges where cited_id is not null and citing_id is not null)")
def gr_adjacency(spark, d):
    return G.adjacency(t(spark, d, "edges"))


COUNTERS = ("book", "old_no_cites", "non_en", "no_title", "no_pubdate", "missing_fields", "not_real_paper")
#: An author is left when one counter, or the sum of all, is above these.
ANY_ABOVE, SUM_ABOVE = 9, 21
# What marks a paper that was not really published.
UNREAL = ("tbd", "under review", "in review", "not published", "poster", "bulletin", "workshop")
_PLACES = ("journal", "source", "conference", "book")
_FIELDS = ("title_main", "cited", "authors", "pubdate", "publisher", "vol", "issue", "pages", "description")


def junk_rules() -> dict:
    """What one paper does to each counter of its author: an addition, or a value to which the counter is set.

    A book in any of the four places counts 1, and 1 more if it is named as the book of an uncited paper; no book sets back to 0.
    An old paper without citations counts 1, another sets back to 0, a year that can't be read sets to 1. A missing title counts 1
    and says nothing of the language; missing dates and many missing fields count 1 or set back to 0. Each pattern found in each
    place counts 1 for papers that were not really published, and nothing sets that back.
    """
    places = [C.unmarked(F.col(c)) for c in _PLACES]
    uncited = F.coalesce(F.col("cited").isin("NA", "couldnt find"), F.lit(False))
    book = C.matches(places, ["book"]) > 0
    year = F.when(C.year_text(F.col("pubdate")).rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"), F.trim(C.year_text(F.col("pubdate"))).cast("int"))
    untitled = C.missing_flag(F.col("titleid")) == 1
    missing = sum((C.missing_flag(F.col(c)) for c in _FIELDS), F.lit(0)) / F.lit(float(len(_FIELDS))) > 0.4
    back = lambda goes_on, to=0: F.when(~goes_on, to)
    return {
        "book": (F.lit(1) + (places[3].isNotNull() & uncited).cast("int"), back(book)),
        "old_no_cites": (F.lit(1), F.when(year.isNull(), 1).when((year >= 1990) | ~uncited, 0)),
        "non_en": ((~untitled).cast("int"), F.when(~untitled & (language(F.col("titleid")) == "en"), 0)),
        "no_title": (F.lit(1), back(untitled)),
        "no_pubdate": (F.lit(1), back(C.missing_flag(F.col("pubdate")) == 1)),
        "missing_fields": (F.lit(1), back(missing)),
        "not_real_paper": (C.matches(places, list(UNREAL)), None),
    }


def _steps() -> str:
    """For each paper of an author what it adds to each counter and, if not NULL, what it sets it to."""
    place = [f"coalesce({S.unmarked(c)}, '')" for c in _PLACES]
    book = "(" + " or ".join(f"contains(lower({p}), 'book')" for p in place) + ")"
    unreal = " + ".join(f"contains(lower({p}), '{w}')::int" for p in place for w in UNREAL)
    gone = lambda c: f"({c} is null or {c} in {S.MARKERS})"
    year = r"case when regexp_full_match(split_part(pubdate, '/', 1), '\s*[+-]?[0-9]{1,9}\s*') then trim(split_part(pubdate, '/', 1))::int end"
    few = f"({' + '.join(f'{gone(c)}::int' for c in _FIELDS)}) / {len(_FIELDS)}e0 > 0.4"
    return rf"""{S.LANGUAGES},
p as (select row_id, scrap_auth_id as a, _file as f, _pos as o, cited in ('NA', 'couldnt find') as uncited, {year} as y, {book} as is_book, {gone('book')} as no_book, {gone('titleid')} as untitled,
 lang, {gone('pubdate')} as undated, {few} as few, {unreal} as unreal from papers_raw left join languages on text = titleid where scrap_auth_id is not null),
steps as (select row_id, a, f, o, 1 + (uncited and not no_book)::int as a_book, case when not is_book then 0 end as r_book,
 1 as a_old_no_cites, case when y is null then 1 when y >= 1990 or not coalesce(uncited, false) then 0 end as r_old_no_cites,
 (not untitled)::int as a_non_en, case when not untitled and lang = 'en' then 0 end as r_non_en, 1 as a_no_title, case when not untitled then 0 end as r_no_title,
 1 as a_no_pubdate, case when not undated then 0 end as r_no_pubdate, 1 as a_missing_fields, case when not few then 0 end as r_missing_fields,
 unreal as a_not_real_paper, null::int as r_not_real_paper from p)"""


_RUNS = f"""{_steps()},
isl as (select *, {', '.join(f'count(r_{x}) over w as g_{x}' for x in COUNTERS)} from steps window w as (partition by a order by f, o rows unbounded preceding)),
runs as (select row_id, a, f, o, {', '.join(f'(sum(coalesce(r_{x}, a_{x}, 0)) over (partition by a, g_{x} order by f, o rows unbounded preceding))::bigint as {x}' for x in COUNTERS)} from isl)"""


def counters(spark, d):
    """Junk counters of every paper of every author."""
    p = t(spark, d, "papers_raw").where("scrap_auth_id is not null").select("row_id", "scrap_auth_id", "_file", "_pos", "titleid", *_PLACES, *_FIELDS)
    rules = junk_rules()
    # a counter may have the name of a column, so both steps of each are taken before
    steps = p.select("row_id", "scrap_auth_id", "_file", "_pos", *[a.alias(f"a_{x}") for x, (a, _) in rules.items()], *[(F.lit(None).cast("int") if r is None else r).alias(f"r_{x}") for x, (_, r) in rules.items()])
    return Z.counters(steps, "scrap_auth_id", "_file", "_pos", {x: (F.col(f"a_{x}"), F.col(f"r_{x}")) for x in rules})


@query(f"with {_RUNS} select row_id, {', '.join(COUNTERS)} from runs")
def win_streaks(spark, d):
    return counters(spark, d).select("row_id", *COUNTERS)


@query(
    f"""with {_RUNS}, hit as (select *, row_number() over (partition by a order by f, o) as rn from runs
 where greatest({', '.join(COUNTERS)}) > {ANY_ABOVE} or {' + '.join(COUNTERS)} > {SUM_ABOVE}) select a as scrap_auth_id, f as _file, o as _pos from hit where rn = 1"""
)
def st_junk_stop(spark, d):
    return Z.stop_rows(counters(spark, d), "scrap_auth_id", ["_file", "_pos"], list(COUNTERS), ANY_ABOVE, SUM_ABOVE)


@query(f"with {_steps()}, first as (select *, row_number() over (partition by a order by f, o) as rn from steps) select a as scrap_auth_id, {', '.join(f'coalesce(r_{x}, a_{x}, 0)::bigint as {x}' for x in COUNTERS)} from first where rn = 1")
def st_reset(spark, d):
    """The counters of each author after the first paper: nothing of the author before is left in them."""
    first = F.min_by(F.struct(*COUNTERS), F.struct("_file", "_pos"))
    return counters(spark, d).groupBy("scrap_auth_id").agg(first.alias("s")).select("scrap_auth_id", "s.*")


@query(
    """with f as (select user_id, event_id, (event_type = 'error')::int as e from events), i as (select *, sum(1 - e) over (partition by user_id order by event_id rows unbounded preceding) as g,
 row_number() over (partition by user_id order by event_id) as tried, sum(1 - e) over (partition by user_id order by event_id rows unbounded preceding) as got from f),
r as (select *, sum(e) over (partition by user_id, g order by event_id rows unbounded preceding) as run from i)
select user_id, min(event_id) as event_id from r where run > 3 or (tried > 5 and got::double / tried < 0.8) group by user_id"""
)
def st_error_budget(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("day"), (F.col("event_type") == "error").alias("bad"))
    rules = {"run": Z.streak(F.col("bad")), "tried": (F.lit(1), None), "got": ((~F.col("bad")).cast("int"), None)}
    s = Z.counters(e, "user_id", "day", "event_id", rules)
    hit = (F.col("run") > 3) | ((F.col("tried") > 5) & (F.col("got") / F.col("tried") < 0.8))
    return s.where(hit).groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query(
    """with f as (select user_id, event_id, event_type = 'error' as bad, event_type = 'view' as empty from events),
g as (select *, count(*) filter (not bad) over w as a, count(*) filter (not bad and not empty) over w as b from f window w as (partition by user_id order by event_id rows unbounded preceding)),
r as (select *, sum(bad::int) over (partition by user_id, a order by event_id rows unbounded preceding) as errors, sum((empty and not bad)::int) over (partition by user_id, b order by event_id rows unbounded preceding) as idle from g)
select event_id, errors::bigint as errors, idle::bigint as idle, case when errors > 3 or idle > 5 then 'stop' when errors > 1 then 'skip' else 'go on' end as step from r"""
)
def st_page_budget(spark, d):
    """What is done after each page of a paper: errors in a row above 1 skip the page and above 3 end the paper, as do more than 5 pages in a
    row without a yield, whatever errors lie between."""
    e = t(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("day"), (F.col("event_type") == "error").alias("bad"), (F.col("event_type") == "view").alias("empty"))
    idle = (F.col("empty") & ~F.col("bad")).cast("int"), F.when(~F.col("empty") & ~F.col("bad"), 0)
    s = Z.counters(e, "user_id", "day", "event_id", {"errors": Z.streak(F.col("bad")), "idle": idle})
    step = F.when((F.col("errors") > 3) | (F.col("idle") > 5), "stop").when(F.col("errors") > 1, "skip").otherwise("go on")
    return s.select("event_id", "errors", "idle", step.alias("step"))


@query(f"with {_LATEST} select id, {_CODE} as state, ts from latest")
def st_work_queue(spark, d):
    last = Z.latest_state(t(spark, d, "status_events"), "id", "status", "ts", "loaded_at")
    return last.select("id", Z.status_code(F.col("status")).alias("state"), "ts")


@query(
    """with f as (select user_id, event_id, (event_type = 'error')::int as e from events), i as (select *, sum(1 - e) over (partition by user_id order by event_id rows unbounded preceding) as g from f)
select user_id, max(n)::bigint as length from (select user_id, g, sum(e) as n from i group by 1, 2) group by user_id"""
)
def stream_error_streaks(spark, d):
    path = f"{d}/events.parquet"
    s = I.file_stream(spark, path, spark.read.parquet(path).schema).select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    return I.longest_streaks(s, "user_id", "event_id", "bad")


@query(
    """select date_trunc('day', ts)::date as day, event_type, count(*) as n from events group by 1, 2
 having date_trunc('day', min(ts)) + interval 1 day <= (select max(ts) - interval 1 hour from events)"""
)
def stream_window_counts(spark, d):
    """Counts of the days that the watermark has closed."""
    path = f"{d}/events.parquet"
    s = I.file_stream(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = I.run_once(I.windowed_counts(s, "ts", "event_type", "1 day", "1 hour"), spark, "windows")
    return counts.select(F.to_date("start").alias("day"), "event_type", "n")
