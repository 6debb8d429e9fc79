"""Relational, text, graph and state operators on small tables; results must not depend on the partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import graph as G
from citeloom.operators import learning as ML
from citeloom.operators import relational as R
from citeloom.operators import skew
from citeloom.operators import state as Z
from citeloom.operators import text as X
from citeloom.sources import markup as M


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_dedup_first(spark, parts):
    df = spark.createDataFrame([("a", "f2", 0, 1), ("a", "f1", 5, 2), ("a", "f1", 3, None), ("b", "f9", 0, 4)], "t string, f string, p int, v int").repartition(parts)
    assert rows(R.dedup_first(df, ["t"], ["f", "p"])) == [("a", "f1", 3, None), ("b", "f9", 0, 4)]
    assert rows(R.dedup_first(df.limit(0), ["t"], ["f", "p"])) == []


@pytest.mark.parametrize("parts", [1, 7])
def test_positions(spark, parts):
    n = 500
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(n)], "i int, k int").repartition(parts)
    got = {r.i: r.position for r in R.row_positions(df, [F.asc("k"), F.asc("i")]).collect()}
    want = {i: p for p, i in enumerate(sorted(range(n), key=lambda i: ((i * 37) % 11, i)))}
    assert got == want


def test_hot_join_is_whole(spark):
    big = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(3000)], "id int, k int")
    classes = big.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = skew.join_class(big, classes, "k", "n", 3000)
    assert got.count() == 3000 and rows(got.where("k = 0").select("first").distinct()) == [(0,)]


def test_quantile_rounding_and_split(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(50)], "k int, p double, a double")
    assert R.top_quantile(df, "p", "k", 0.05).count() == 2  # half to even of 2.5
    r = R.quantile_overlap(df, "p", "a", "k", 0.05).first()
    assert (r.n_both, r.n_top, r.share) == (0, 2, 0.0)
    d = spark.createDataFrame([("2019-06-30",), ("2019-07-01",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    assert [x.part for x in R.split_by_date(d, "d", "2019-07-01").orderBy(F.col("d").asc_nulls_last()).collect()] == ["train", "test", None]


def test_shuffle_keeps_the_values(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(200)], "k int, v int")
    got = R.shuffled_match(df, "k", "v").collect()
    assert sorted(r.v_shuffled for r in got) == sorted(r.v for r in got) and any(r.v != r.v_shuffled for r in got)


def test_topic_share(spark):
    pairs = spark.createDataFrame([("a", f"p{i}") for i in range(10)] + [("b", "p0"), ("b", "p0"), ("b", "p9")], "g string, i string")
    got = rows(R.topic_share(pairs, "g", "i", F.col("i") == "p0", 0.1))
    assert got == [("b", 2, 1, 0.5)]  # one in ten isn't more than a tenth; a repeat counts once


LEMMAS = [
    (["cell", "cells", "dog1"], {("cells", "cell")}),
    (["magnet", "magnetic", "magnetics"], {("magnetic", "magnet"), ("magnetics", "magnet")}),
    (["coat", "coated"], {("coated", "coat")}),
    (["magazine", "magnet", "magnets"], set()),
    (["abc", "abcs"], set()),
    (["work", "working"], set()),
]


@pytest.mark.parametrize("words,want", LEMMAS)
def test_lemmas(spark, words, want):
    assert set(rows(X.lemma_map(spark.createDataFrame([(w,) for w in words], "term string")))) == want


def test_min_df(spark):
    feats = spark.createDataFrame([(i, "title", "t19") for i in range(19)] + [(i, "title", "t20") for i in range(20)] + [(i, "author", "a") for i in range(2)] + [(0, "year", "1999")], "doc_id int, field string, term string")
    vocab = X.frequent(feats)
    assert {r.term for r in vocab.collect()} == {"t20", "a", "1999"}
    assert X.multi_hot(spark.createDataFrame([(5, "title", "unseen"), (5, "author", "a")], feats.schema), vocab).collect() == [(5, "author:a")]


def bfs_brute(edges, start, expand=None, limit=None):
    level, frontier, n = {start: 0}, [start], 0
    adj = {}
    for a, b in set(edges):
        adj.setdefault(a, set()).add(b)
    while frontier:
        n += 1
        owner = {}
        known = dict(level)
        for a in sorted(frontier):
            if n > 1 and expand is not None and a not in expand:
                continue
            for b in adj.get(a, ()):
                if b not in known:
                    owner.setdefault(b, a)
        fresh = {}
        for b, a in owner.items():
            fresh[a] = fresh.get(a, 0) + 1
        frontier = []
        for b, a in owner.items():
            level[b] = n
            kids = len(adj[a])
            if limit is None or (kids - fresh[a]) / kids < limit:
                frontier.append(b)
    return sorted(level.items())


@pytest.mark.parametrize("limit", [None, 0.9, 0.3])
def test_bfs(spark, limit):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randint(0, 20) ** 2 // 20:02}", f"n{rnd.randint(0, 30):02}") for _ in range(90)] + [("n00", "n00"), ("n01", "n00"), ("n00", "n01")]
    e = spark.createDataFrame([*edges, (None, "n05")], "cited_id string, citing_id string")
    start = spark.createDataFrame([("n00",)], "id string")
    expand = {f"n{i:02}" for i in range(0, 31, 2)}
    x = spark.createDataFrame([(i,) for i in expand], "id string")
    assert rows(G.bfs_levels(e, start, None, limit)) == bfs_brute(edges, "n00", None, limit)
    assert rows(G.bfs_levels(e, start, x, limit)) == bfs_brute(edges, "n00", expand, limit)
    assert rows(G.bfs_levels(e, spark.createDataFrame([("alone",)], "id string"))) == [("alone", 0)]


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_connected(spark, shape):
    rnd = random.Random(6)
    names = [f"n{i:03}" for i in range(120)]
    rnd.shuffle(names)
    edges = {"random": [(rnd.choice(names), rnd.choice(names)) for _ in range(70)], "chain": list(zip(names, names[1:])), "star": [(names[0], x) for x in names], "none": []}[shape]
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = sorted((n, find(n)) for n in names if any(n in e and e[0] != e[1] for e in edges))
    df = spark.createDataFrame([*edges, (None, names[0]), (names[1], names[1])], "a string, b string")
    assert rows(G.connected(df)) == want


def test_streaks_over_chunks(spark):
    rnd = random.Random(5)
    data, want = [], {}
    for k in "ab":
        run = total = 0
        for c in range(6):
            for o in range(rnd.choice([1, 1, 4])):
                f = rnd.random() < 0.7
                run, total = (run + 1 if f else 0), total + f
                data.append((k, c, o, f))
                want[(k, c, o)] = (run, total)
    df = spark.createDataFrame(data, "k string, c int, o int, f boolean").repartition(5)
    s = Z.counters(df, "k", "c", "o", {"run": Z.streak(F.col("f")), "total": (F.col("f").cast("int"), None)})
    assert {(r.k, r.c, r.o): (r.run, r.total) for r in s.collect()} == want
    stop = Z.stop_rows(s, "k", ["c", "o"], ["run"], 3, 99)
    for r in stop.collect():
        assert (r.c, r.o) == min((c, o) for (k, c, o), (run, _) in want.items() if k == r.k and run > 3)


def junk_loop(papers):
    """The rules for junk over the papers of one author in order, as plainly as they are stated."""
    from citeloom.plans.walks import UNREAL

    n = dict.fromkeys(("book", "old_no_cites", "non_en", "no_title", "no_pubdate", "missing_fields", "not_real_paper"), 0)
    gone = lambda v: v in (None, "NA", "couldnt find", "cant read from scrapper out")
    out = []
    for p in papers:
        uncited = p["cited"] in ("NA", "couldnt find")
        places = [p[c].lower() for c in ("journal", "source", "conference", "book") if not gone(p[c])]
        if any("book" in v for v in places):
            n["book"] += 2 if not gone(p["book"]) and uncited else 1
        else:
            n["book"] = 0
        try:
            n["old_no_cites"] = n["old_no_cites"] + 1 if int(p["pubdate"].split("/")[0]) < 1990 and uncited else 0
        except (ValueError, AttributeError):
            n["old_no_cites"] = 1
        if gone(p["titleid"]):
            n["no_title"] += 1
        else:
            n["no_title"] = 0
            n["non_en"] = n["non_en"] + 1 if p["titleid"].startswith("Die ") else 0
        n["no_pubdate"] = n["no_pubdate"] + 1 if gone(p["pubdate"]) else 0
        fields = ("title_main", "cited", "authors", "pubdate", "publisher", "vol", "issue", "pages", "description")
        n["missing_fields"] = n["missing_fields"] + 1 if sum(gone(p[f]) for f in fields) / len(fields) > 0.4 else 0
        n["not_real_paper"] += sum(w in v for w in UNREAL for v in places)
        out.append(dict(n))
    return out


@pytest.mark.parametrize("chunk", [3, 50_000])
def test_junk_rules_against_a_loop(spark, monkeypatch, chunk):
    """Counters, resets over files and parts of files, and the place where an author is left."""
    from citeloom.plans import walks

    monkeypatch.setattr(Z, "CHUNK", chunk)
    rnd = random.Random(12)
    pick = lambda *v: rnd.choice(v)
    text = ["titleid", "title_main", "cited", "authors", "pubdate", "journal", "source", "conference", "book", "publisher", "vol", "issue", "pages", "description", "scrap_auth_id", "_file"]
    data, want, stops, left = [], {}, {}, {}
    for a in ("a", "b", "c", None):
        papers = []
        for i in range(120):
            p = {c: pick("x", "x", None, "NA", "couldnt find") for c in text} | {"scrap_auth_id": a, "_file": f"f{i // 17:02}", "_pos": i % 17, "row_id": len(data)}
            p |= {"titleid": pick("The growth of films", "Die Rolle von Glas für Zellen", None, "NA"), "pubdate": pick("1985/2", "2001", "NA", None, "19x/1", "1970", "1980/1/2"), "cited": pick("NA", "Cited by 3", "couldnt find", None)}
            where = pick("journal", "source", "conference", "book")
            p |= dict.fromkeys(("journal", "source", "conference", "book")) | {where: pick("A Book of X", "Books", "NA", "Workshop", "poster, in review", "J. Y", "Physics")}
            papers.append(p)
            data.append(p)
        if a:
            for p, n in zip(papers, junk_loop(papers)):
                want[p["row_id"]] = n
                if a not in stops and (max(n.values()) > 9 or sum(n.values()) > 21):
                    stops[a] = (p["_file"], p["_pos"])
            left[a] = want[papers[0]["row_id"]]
    df = spark.createDataFrame(data, ", ".join([*(f"{c} string" for c in text), "_pos long", "row_id long"])).repartition(7)
    monkeypatch.setattr(walks, "t", lambda spark, d, name: df)
    assert {r.row_id: {c: r[c] for c in walks.COUNTERS} for r in walks.win_streaks(spark, "").collect()} == want
    assert {r.scrap_auth_id: (r._file, r._pos) for r in walks.st_junk_stop(spark, "").collect()} == stops and len(stops) == 3
    assert {r.scrap_auth_id: {c: r[c] for c in walks.COUNTERS} for r in walks.st_reset(spark, "").collect()} == left
    assert walks.counters(spark, "").where("false").count() == 0


def test_latest_state(spark):
    df = spark.createDataFrame([("a", "1", 5, 1), ("a", "False", 3, 9), ("b", None, None, 1), ("b", "404", 1, 0), (None, "1", 1, 1)], "id string, s string, t int, l int")
    assert rows(Z.latest_state(df, "id", "s", "t", "l").select("id", Z.status_code(F.col("s")))) == [("a", "done"), ("b", "gone")]


def test_learning(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r], int(r[0] + 0.1 * r[1] > 0.8)) for i, r in enumerate(x)], "k int, c array<double>, y int")
    for n in (5, 400):  # exact, and by iteration, from a broadcast and by joins
        m = x if n == 5 else rng.normal(size=(200, n)) * (0.9 ** np.arange(n))
        wide = spark.createDataFrame([(j, [i for i in range(n)], [float(v) for v in r]) for j, r in enumerate(m)], "row_id int, indices array<int>, values array<double>")
        for broadcast in (10**6, 0):
            s, v = ML.truncated_svd(wide, n, 3, broadcast=broadcast, extra=8 if n > 5 else 2)
            assert np.allclose(s, np.linalg.svd(m, compute_uv=False)[:3], rtol=1e-5)
            y = np.array([r.components for r in ML.project(wide, v).orderBy("row_id").collect()])
            assert np.allclose(np.linalg.norm(y, axis=0), s, rtol=1e-5)
            vectors = v if broadcast else v.orderBy("index").toPandas()[["v0", "v1", "v2"]].to_numpy()
            assert np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-4) and (vectors[np.abs(vectors).argmax(axis=0), range(3)] > 0).all()
    w = ML.ridge_fit(df, "c", 5, "y", 2.0)
    a = np.hstack([x, np.ones((200, 1))])
    t = np.where(np.array([r.y for r in df.orderBy("k").collect()]) == 1, 1.0, -1.0)
    p = 2.0 * np.eye(6)
    p[5, 5] = 0
    assert np.allclose(w, np.linalg.solve(a.T @ a + p, a.T @ t))
    scored = ML.ridge_score(df, "c", w)
    got = ML.auc(scored, "score", "y")
    z, y = a @ w, t > 0
    want = np.mean([(z[i] > z[j]) + 0.5 * (z[i] == z[j]) for i in np.flatnonzero(y) for j in np.flatnonzero(~y)])
    assert abs(got - want) < 1e-9
    counts = {r.y: r["count"] for r in ML.oversample(df, "y", "k").groupBy("y").count().collect()}
    assert counts[0] == counts[1]


PAPER = "row_id long, titleid string, authors string, journal string, publisher string, year string, pages string, vol string, issue string, author_ids string"


def test_encoder(spark):
    """An author id of five papers is a feature, one of four is not; variants of title words are their lemma; unseen terms and papers without any are encoded all the same."""
    data = [(i, f"magnet{'ic' if i % 2 else ''} {'x' * 3}{i}", None, None, None, "2015", "1", "1", "1", "a b" if i < 4 else "a" if i == 4 else None) for i in range(24)]
    train = spark.createDataFrame(data, PAPER)
    e = ML.fit_encoder(train)
    names = {r["index"]: f"{r.field}:{r.term}" for r in e.vocabulary.collect()}
    assert names == {0: "author_id:a", 1: "title:magnet", 2: "year:2015"} and e.size == 3
    later = spark.createDataFrame([(100, "magnetic magnet unseen", None, None, None, "1991", "1", None, "NA", "b a a"), (101, None, None, None, None, None, "1", "1", "1", None)], PAPER)
    got = {r.row_id: (r.indices, r["values"], r.year) for r in ML.encode(later, e, ["row_id", "year"]).collect()}
    assert got == {100: ([0, 1], [1.0, 1.0], "1991"), 101: ([], [], None)}
    assert ML.fit_encoder(train.limit(0)).size == 0


def test_vocabulary_has_no_bound(spark):
    """Every term in enough papers is kept, however many there are."""
    df = spark.range(60_000).select(F.col("id").alias("row_id"), *[F.lit(None).cast("string").alias(c) for c in ("titleid", "journal", "publisher", "year", "author_ids")], F.concat_ws(",", *[F.concat(F.lit(f"n{i}x"), F.floor(F.col("id") / 2)) for i in range(5)]).alias("authors"), *[F.lit("1").alias(c) for c in ("pages", "vol", "issue")])
    assert ML.fit_encoder(df).size == 150_000


def test_papers_have_author_ids(spark, monkeypatch):
    from citeloom.plans import features

    text = ["titleid", "title_main", "authors", "journal", "conference", "source", "book", "publisher", "vol", "issue", "pages", "pubdate", "cited", "scrap_auth_id", "urlid", "_file"]
    raw = [{c: None for c in text} | {"titleid": f"the effect of the light on the cells {i}", "pubdate": "2015/3/1", "cited": "Cited by 9", "_file": "f", "row_id": i, "_pos": i} for i in range(2)]
    tables = {"papers_raw": spark.createDataFrame(raw, ", ".join([*(f"{c} string" for c in text), "row_id long", "_pos long"])), "paper_authors": spark.createDataFrame([(raw[0]["titleid"], "x y")], "titleid string, author_ids string")}
    monkeypatch.setattr(features, "t", lambda spark, d, name: tables[name])
    assert rows(features._papers(spark, "").select("row_id", "author_ids", "year")) == [(0, "x y", "2015"), (1, None, "2015")]


@pytest.mark.parametrize("n", [0, 1, 7, 2500])
def test_group_concat_of_any_length(spark, n, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 100)
    df = spark.createDataFrame([("k", f"{i * 7919 % n:05}") for i in range(n)] + [("other", "b"), ("other", "a"), ("other", "a")], "k string, v string").repartition(5)
    got = {r.k: r.v for r in R.group_concat(df, "k", "v", ["v"]).collect()}
    assert got == ({"k": " ".join(f"{i:05}" for i in range(n))} if n else {}) | {"other": "a a b"}


@pytest.mark.parametrize("kind", ["different", "ties", "nulls", "few"])
def test_top_quantile(spark, kind):
    rnd = random.Random(9)
    n = 3 if kind == "few" else 4000
    data = [(i, {"ties": float(i % 3), "nulls": None if i % 2 else rnd.random()}.get(kind, rnd.random())) for i in range(n)]
    df = spark.createDataFrame(data, "k int, v double").repartition(6)
    for q in (0.0, 0.05, 0.3, 1.0):
        want = sorted(data, key=lambda r: (-(r[1] if r[1] is not None else -9), r[0]))[: round(n * q)]
        assert rows(R.top_quantile(df, "v", "k", q).select("k")) == sorted([(r[0],) for r in want], key=repr)


def test_class_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 5 + [(0, 1)], "y int, p int")
    r = {x["class"]: x for x in R.class_metrics(df).collect()}
    assert (r[1].precision, r[1].recall, r[1].f1, r[1].support, r[1].accuracy) == (0.75, 0.75, 0.75, 4, 0.8)
    assert abs(r[0].macro_f1 - (0.75 + 5 / 6) / 2) < 1e-12 and r[0].macro_f1 == r[1].macro_f1
    one = {x["class"]: x for x in R.class_metrics(df.where("y = 0 and p = 0")).collect()}
    assert one[1].precision is None and one[1].recall is None and one[0].accuracy == 1.0 and one[0].macro_recall == 0.5


def test_boosting_stops_early(spark):
    assert ML.best_round([3, 2, 2.5, 1, 4, 4, 4], patience=3) == (4, True)
    assert ML.best_round([3, 2, 2.5, 1], patience=3) == (4, False)
    assert ML.best_round([1, 2, 2, 2, 0], patience=3) == (1, True)


def test_gbt_clf_resamples_earlier_papers_only(spark, monkeypatch):
    """Classes at 10; the fit gets equal classes of the earlier papers, the later ones as they are, and all are predicted."""
    from citeloom.plans import features

    data = [(i, f"{2015 + i // 30}-01-02", 20.0 if i % 10 == 0 else 5.0, [float(i % 10 == 0), float(i % 3)]) for i in range(150)]
    c = spark.createDataFrame(data, "row_id long, date string, cites_per_year double, components array<double>").withColumn("date", F.col("date").cast("date")).withColumn("label", F.lit(1))
    parts, asked, real = [], [], ML.gbt_classifier
    monkeypatch.setattr(ML, "ROUNDS", 1)
    monkeypatch.setattr(ML, "PATIENCE", -9)
    monkeypatch.setattr(features, "checkpointed", lambda df: df)
    monkeypatch.setattr(features, "_components", lambda spark, d, k=2, first_test=None: asked.append(first_test) or c)
    monkeypatch.setattr(ML, "gbt_classifier", lambda train, held, *a: parts.extend([train, held]) or real(train, held, *a))
    got = {r.row_id: r.predicted for r in features.ml_gbt_clf(spark, "").collect()}
    assert got == {i: int(i % 10 == 0) for i in range(150)} and asked == ["2018-07-01"]
    counts = [{r.label: r["count"] for r in p.groupBy("label").count().collect()} for p in parts]
    assert counts == [{0.0: 108, 1.0: 108}, {0.0: 27, 1.0: 3}]
    assert max(r.row_id for r in parts[0].collect()) < min(r.row_id for r in parts[1].collect())


def test_markup(spark):
    page = '<html><div class="gs_r"><h3 class="t">A &amp; b</h3><div><div>Journal</div><div>J <b>of</b> X</div></div><br></div><!-- <h3 class="t">no</h3> --><script>"<h3>"</script>'
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<h3 class=t>open")], "k int, p string")
    assert rows(M.extract_nodes(df, "k", "p", "class", "t")) == [(1, 0, "A & b"), (4, 0, "open")]
    got = {r.k: (r.j, r.v) for r in M.extract_fields(df, "k", "p", {"j": ["Source", "Journal"], "v": ["Volume"]}).collect()}
    assert got == {1: ("J of X", None), 2: (None, None), 3: (None, None), 4: (None, None)}
