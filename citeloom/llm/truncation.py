"""Text cut off by field limits.

Each source's complete lengths are taken as log-normal and fitted by maximum likelihood with the values that pile up at a
limit as right-censored observations. At every length the posterior that a text without an end was censored follows from the
number of such texts there against the number that the fitted law leads one to expect. Its log-odds, and those of the ending,
add up to the score of every text that has no end.

The evidence of an ending is a likelihood ratio fitted on the corpus: a logistic model separates the endings at limits, weighted
by the posterior, from the ends of all sentences with their mark removed. It sees the kind of the ending (a mark of omission, one
that needs something after it, a list of keywords, other), how often the last words stand inside sentences and how often at the
end (pairs shrunk towards words, words towards all, so that no number of occurrences is a threshold), and how new the last word
is. Its weights have a normal prior, which decides where a corpus has no limits.

Defined results: NULL, the markers of missing text and blank texts are no cases; a text with a closing mark is whole, whatever
its length, unless the mark may be half a number and the limit says so; a formula such as "and so on..." is an end; a NULL source
is a source of its own; a source with few texts has no limit, then the ending alone decides; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.sentences import NUMBERED, TITLES
from citeloom.operators.split_values import MISSING_MARKERS
from citeloom.session import checkpointed

CLOSERS = r"[\s\p{Z}]?[\"'”’»」』)\]“]*"
CLOSED = rf"[.!?。！？।؟]{CLOSERS}$"
#: Marks of omission, with the words that some sites put after them, broken characters and half-sent escapes or tags.
OMITTED = r"(?i)(?:(?:…|\.{3,}|\[\s*(?:…|\.{2,})\s*\])\s*(?:[(\[]?(?:read |see |show |view )?(?:more|continued|cont\.?|truncated|weiterlesen|mehr|suite|ver más)[)\]]?)?|[(\[](?:continued|truncated|cut|abridged)[)\]]|�+|\\u?[0-9a-f]{0,4}|&#?[a-z0-9]{0,8};?|<[/a-z]{0,10})$"
FORMULA = r"(?i)(?:\band so (?:on|forth)|\betc|\busw|\bund so weiter|\bainsi de suite|\betcétera|\by así sucesivamente|и т\. ?д|和等等|等等)\s*(?:…|\.{3,})$"
#: Abbreviations that need something after them; the second also has initials.
_SHORT = "|".join(re.escape(w) for w in sorted({w for t in (TITLES, NUMBERED) for ws in t.values() for w in ws.split()}, key=len, reverse=True))
SHORT_WORD = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{_SHORT})\.$"
ABBREVIATED = rf"(?<![\p{{L}}\p{{N}}])(?:{_SHORT}|z\. ?B|d\. ?h|т\. ?е|(?<!\d )\p{{Lu}})\.$"
DECIMAL = r"\p{N}\.$"
DANGLING = r"[,;:(\[“„«‘/–—-]$"
KEYWORDS = r"(?i)(?:^|[.!?。]\s+)(?:key ?words?|index terms|schlagwörter|stichworte|mots[- ]clés|palabras clave|ключевые слова|关键词|キーワード)\s*[:：][^.!?]*$|(?:©|\(c\) |copyright )[^.!?]{0,80}$"
#: Scripts written without marks at the end of sentences.
UNMARKED = r"[\p{InThai}\p{InLao}\p{InKhmer}\p{InMyanmar}]"
IDEOGRAM = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"

BLANKS = " \t\n\r\x0b\x0c\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

PRIOR_CUT = 0.3  # of a text without an end that is at no limit, before the corpus is seen
LACKING = 0.08  # share of whole texts without a closing mark
WINDOW = 10  # a limit that respects words spreads the cuts over so many characters
SHRINK = 1.0  # occurrences that a word's or pair's own counts are set against
#: What the evidence consists of, with the mean of each weight before the corpus is seen.
EVIDENCE = {"omitted": 6.0, "dangling": 6.0, "open": 0.0, "keywords": -6.0, "inside": 1.0, "new": 5.0, "new_keyword": 8.0, "letter": -1.5}
#: Precision of that prior; the corpus counts as at most so many endings of either kind.
PRECISION, SAMPLE = 1.0, 2_000.0
STEP = {"posterior": 0.05, "inside": 0.5, "new": 0.25, "letter": 0.25}  # grid on which endings are counted for the fit
MOST = 8.0  # the log-odds of words are counted up to here


def fit_censored(length: np.ndarray, n_exact: np.ndarray, n_censored: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Mean and deviation of log length; EM for the normal law with right-censored observations."""
    x, w, c = np.log(length), n_exact.astype(float), n_censored.astype(float)
    if w.sum() < 2:
        return (float((x * (w + c)).sum() / max((w + c).sum(), 1)) if len(x) else 0.0), 1.0
    mu = (x * w).sum() / w.sum()
    sd = max(math.sqrt((w * (x - mu) ** 2).sum() / w.sum()), 0.05)
    for _ in range(rounds):
        z = (x - mu) / sd
        tail = np.maximum(np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z]), 1e-12)
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        m1 = mu + sd * hazard  # E[x | x > limit]
        m2 = mu * mu + sd * sd + sd * (x + mu) * hazard  # E[x^2 | x > limit]
        total = w.sum() + c.sum()
        new = ((w * x).sum() + (c * m1).sum()) / total
        var = ((w * x * x).sum() + (c * m2).sum()) / total - new * new
        moved, mu, sd = abs(new - mu), new, max(math.sqrt(max(var, 0)), 0.05)
        if moved < 1e-6:
            break
    return float(mu), float(sd)


def censoring(pdf: pd.DataFrame) -> pd.DataFrame:
    """Posterior of censoring for each length of one source that has texts without an end."""
    pdf = pdf.sort_values("len")
    n, whole, opened = (pdf[c].to_numpy() for c in ("len", "n_closed", "n_open"))
    total = whole.sum() + opened.sum()
    cens, best = np.zeros(len(n)), np.zeros(len(n))
    mu = sd = 0.0

    def below(x: np.ndarray) -> np.ndarray:
        """Share of the fitted law up to x."""
        z = (np.log(np.maximum(x, 1e-9)) - mu) / sd
        return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])

    for _ in range(2):  # limits with the uncensored fit first, then again with the censored one
        mu, sd = fit_censored(n, whole, np.round(cens))
        best = np.zeros(len(n))
        left = opened.astype(float)  # what piles up at one length says nothing of the lengths around it
        for width in (1, WINDOW):
            c_open = np.concatenate(([0], np.cumsum(left)))
            for back in {0, width // 2, width - 1}:  # the length may be anywhere in the window below the limit
                hi = n + back
                lo = hi - width + 1
                seen = c_open[np.searchsorted(n, hi, "right")] - c_open[np.searchsorted(n, lo, "left")]
                want = np.maximum(LACKING * total * (below(hi + 0.5) - below(lo - 0.5)), 1e-6)
                significant = (seen >= 5) & (seen - want > 4 * np.sqrt(want + 1))
                best = np.maximum(best, np.where(significant, 1 - np.minimum(1, np.maximum(want, 0.5) / np.maximum(seen, 1)), 0))
            left[best > 0] = 0
        cens = best * opened
    out = best
    keep = opened > 0
    return pd.DataFrame({"source": pdf["source"].to_numpy()[keep], "len": n[keep], "posterior": out[keep], "mu": mu, "sd": sd})


def _endings(df: DataFrame, column: str, record: str, source: str) -> DataFrame:
    text = F.btrim(F.col("_t"), F.lit(BLANKS))
    d = df.select(F.col(record).alias("_rec"), F.col(source).alias("_s"), F.col(column).alias("_t")).where(F.col("_t").isNotNull() & ~F.col("_t").isin(*MISSING_MARKERS))
    d = d.select("_rec", F.when(F.col("_s").isNull() | F.col("_s").isin(*MISSING_MARKERS), "").otherwise(F.col("_s")).alias("source"), F.length("_t").alias("len"), text.alias("_t")).where("_t <> ''")
    t = F.col("_t")
    # all of these marks are within the last 40 characters; a plain full stop decides most texts at once
    tail = F.right(t, F.lit(40))
    kind = (
        F.when(F.endswith(t, F.lit(".")) & ~F.endswith(t, F.lit("...")), F.when(F.right(t, F.lit(12)).rlike(ABBREVIATED), "dangling").when(F.right(t, F.lit(2)).rlike(DECIMAL), "decimal").otherwise("closed"))
        .when(tail.rlike(FORMULA), "closed")
        .when(tail.rlike(OMITTED), "omitted")
        .when(F.right(t, F.lit(8)).rlike(CLOSED) | F.right(t, F.lit(1)).rlike(UNMARKED), "closed")
        .when(tail.rlike(DANGLING), "dangling")
        .otherwise("open")
    )
    return d.withColumn("kind", kind)


def _spaced(text):
    """Digits as one form, ideograms as words of one letter; a full stop before a small letter ends no sentence and becomes a dot."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, r"\.(?=[\s\p{Z}]+\p{Ll})", "·")), r"\p{N}+", "0")
    return F.when(text.rlike(IDEOGRAM), F.regexp_replace(plain, rf"({IDEOGRAM})(?![。！？.!?])", "$1 ")).otherwise(plain)


SPACE = r"[\s\p{Z}]+"


def _word(c):
    return F.regexp_replace(c, rf"[.!?。！？।؟]{CLOSERS}$", "")


def fit_evidence(x: np.ndarray, cut: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Weights of the evidence: logistic regression by Newton's method with a normal prior; both sides count equally, so the linear
    part is the logarithm of the likelihood ratio. x: one row for each kind of ending; cut, whole: how many of it there are.
    """
    mean = np.array(list(EVIDENCE.values()))
    size = min(cut.sum(), whole.sum(), SAMPLE)
    if size < 1:
        return mean
    cut, whole = cut * (size / cut.sum()), whole * (size / whole.sum())
    w = mean.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) * (cut + whole) - z * cut).sum() + PRECISION / 2 * ((w - mean) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p * (cut + whole) - cut) + PRECISION * (w - mean)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) * (cut + whole))[:, None]) + PRECISION * np.eye(len(w)), slope)
        t, now = 1.0, loss(w)
        while t > 1e-6 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return w


def fit_prior(evidence: np.ndarray, n: np.ndarray, rounds: int = 50) -> float:
    """Share of cut texts among those without an end at no limit: EM with the evidence given; one text counts as the prior."""
    p = PRIOR_CUT
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(math.log(p / (1 - p)) + evidence, -30, 30)))
        p = min(max(((r * n).sum() + PRIOR_CUT) / (n.sum() + 1), 0.01), 0.9)
    return p


def truncated(df: DataFrame, column: str, record: str, source: str) -> DataFrame:
    """(record, source, len, kind, score): every text with the log-odds that its end was cut away; NULL score: whole for sure."""
    d = _endings(df, column, record, source)
    last2 = F.slice(F.split(_spaced(F.right(F.col("_t"), F.lit(200))), SPACE), -2, 2)
    is_open = F.col("kind") == "open"
    ends = d.select("_rec", "source", "len", "kind", F.xxhash64("_t").alias("text"), F.when(is_open, last2).alias("last"), (is_open & F.right(F.col("_t"), F.lit(400)).rlike(KEYWORDS)).alias("keywords"))
    ends = checkpointed(ends)

    # how often words and pairs of words end a sentence or stand inside one, over all texts; combined in each task before the
    # shuffle. The last word of a text without an end may be a fragment and is no evidence.
    tokens = F.split(_spaced(F.col("_t")), SPACE)
    used = F.when(F.col("kind").isin("closed", "decimal"), F.size("w")).otherwise(F.size("w") - 1)
    grams = d.select("kind", tokens.alias("w")).select("w", F.posexplode(F.slice("w", 1, F.greatest(used, F.lit(0)))).alias("i", "b"))
    g = grams.select(F.when(F.col("i") > 0, F.element_at("w", F.col("i"))).otherwise("").alias("a"), "b").groupBy("a", "b").agg(F.count("*").alias("n"))
    final = F.col("b").rlike(CLOSED) & ~F.col("b").rlike(SHORT_WORD)
    g = g.select(F.concat_ws(" ", "a", _word(F.col("b"))).alias("pair"), _word(F.col("b")).alias("word"), F.when(final, F.col("n")).otherwise(0).alias("nf"), F.when(final, 0).otherwise(F.col("n")).alias("nm"))
    pairs = checkpointed(g.groupBy("pair", "word").agg(F.sum("nf").alias("pf"), F.sum("nm").alias("pm")))
    words = checkpointed(pairs.groupBy("word").agg(F.sum("pf").alias("wf"), F.sum("pm").alias("wm")))
    tf, tm = words.agg(F.sum("wf"), F.sum("wm")).first()
    rate = ((tf or 0) + 1) / ((tf or 0) + (tm or 0) + 2)  # of sentence ends among all words

    n = lambda c: F.coalesce(c, F.lit(0))

    def seen(less: int) -> dict:
        """What the last words say; ``less`` takes an ending out of the counts to which it has been added itself."""
        wf, pf = F.greatest(n(F.col("wf")) - less, F.lit(0)), F.greatest(n(F.col("pf")) - less, F.lit(0))
        of_word = (wf + SHRINK * rate) / (wf + n(F.col("wm")) + SHRINK)
        of_pair = (pf + SHRINK * of_word) / (pf + n(F.col("pm")) + SHRINK)
        inside = F.log((1 - of_pair) / of_pair) - math.log((1 - rate) / rate)
        letter = (F.length("word") == 1) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(IDEOGRAM)  # a unit or a fragment
        return {"inside": F.greatest(F.lit(-MOST), F.least(inside, F.lit(MOST))), "new": SHRINK / (wf + n(F.col("wm")) + SHRINK), "letter": F.coalesce(letter, F.lit(False)).cast("int") * SHRINK / (pf + n(F.col("pm")) + SHRINK)}

    whole = F.col("kind").isin("closed", "decimal")
    # copies of a text have its length for one reason, so each text counts once in a source
    hist = ends.groupBy("source", "len", "kind", "text").agg(F.lit(1)).groupBy("source", "len").agg(F.count(F.when(whole, 1)).alias("n_closed"), F.count(F.when(~whole, 1)).alias("n_open"), F.count(F.when(F.col("kind") == "decimal", 1)).alias("n_decimal"))
    hist = checkpointed(hist)
    limits = checkpointed(hist.groupBy("source").applyInPandas(censoring, "source string, len int, posterior double, mu double, sd double"))
    hist = hist.join(limits.select("source", "len", "posterior"), ["source", "len"])

    rows = ends.where(~whole).select("_rec", "source", "len", "kind", "keywords", F.element_at("last", -1).alias("word"), F.concat_ws(" ", "last").alias("pair"))
    rows = rows.join(pairs.drop("word"), "pair", "left").join(words, "word", "left").join(limits.select("source", "len", "posterior"), ["source", "len"], "left")
    # an ending that many lists of keywords and notices share is not new, even if it stands nowhere else
    shared = ends.where("keywords").groupBy(F.concat_ws(" ", "last").alias("pair")).agg(F.count("*").alias("_same"))
    listed = ends.where("keywords").count()
    rows = rows.join(shared.withColumn("keywords", F.lit(True)), ["pair", "keywords"], "left").withColumns(seen(0))
    others = 100.0 * (n(F.col("_same")) - 1) / max(listed, 1)  # in hundredths, so it doesn't grow with the corpus
    rows = rows.withColumn("new", F.when(F.col("keywords"), 1 / (1 / F.col("new") + others / SHRINK)).otherwise(F.col("new")))
    rows = checkpointed(rows.select("_rec", "source", "len", "kind", "keywords", n(F.col("posterior")).alias("posterior"), "inside", "new", "letter"))

    # counted on a grid, so as few rows come to the driver as the grid has points
    on_grid = lambda c: (F.round(F.col(c) / STEP[c]) * STEP[c]).alias(c)
    grid = ["inside", "new", "letter"]
    told = rows.groupBy(F.when(F.col("keywords"), "keywords").otherwise(F.col("kind")).alias("kind"), on_grid("posterior"), *map(on_grid, grid)).agg(F.count("*").alias("n")).collect()
    stripped = pairs.join(words, "word").where("pf > 0").withColumns(seen(1))
    stripped = stripped.groupBy(F.when(F.col("pair").rlike(DANGLING), "dangling").otherwise("open").alias("kind"), *map(on_grid, grid)).agg(F.sum("pf").alias("n")).collect()
    at = hist.agg(F.sum("n_closed"), F.sum(F.col("posterior") * F.col("n_open")), F.sum(F.col("posterior") * F.col("n_decimal"))).first()
    n_whole, n_cut, n_half = (float(v or 0) for v in at)
    n_decimal = float(ends.where("kind = 'decimal'").count())
    n_texts = float(ends.where(whole).count())

    def vector(r) -> list[float]:
        o, k = r["kind"] == "open", r["kind"] == "keywords"
        return [r["kind"] == "omitted", r["kind"] == "dangling", o, k, o * r["inside"], o * r["new"], k * r["new"], o * r["letter"]]

    ended = sum(r["n"] for r in stripped) or 1
    x, cut, kept = [], [], []
    for r in told:
        x.append(vector(r))
        cut.append(r["n"] * r["posterior"] if r["posterior"] > 0.5 else 0.0)
        # a list of keywords has no mark to remove: those at no limit stand for the whole ones
        kept.append(r["n"] * (1 - PRIOR_CUT) if r["kind"] == "keywords" and r["posterior"] <= 0.5 and r["new"] < 0.5 else 0.0)
    for r in stripped:
        x.append(vector(r))
        cut.append(0.0)
        kept.append(r["n"] / ended * LACKING * n_texts)
    x, cut, kept = np.array(x, float).reshape(-1, len(EVIDENCE)), np.array(cut), np.array(kept)
    weight = fit_evidence(x, cut, kept)
    free = [i for i, r in enumerate(told) if r["posterior"] <= 0]
    prior = fit_prior(x[free] @ weight, np.array([told[i]["n"] for i in free], float)) if free else PRIOR_CUT

    o, k = F.lit(1.0) * (is_open & ~F.col("keywords")).cast("int"), F.lit(1.0) * F.col("keywords").cast("int")
    parts = [(F.col("kind") == "omitted").cast("int"), (F.col("kind") == "dangling").cast("int"), o, k, o * F.col("inside"), o * F.col("new"), k * F.col("new"), o * F.col("letter")]
    p = F.greatest(F.col("posterior"), F.lit(prior))
    score = F.log(p / (1 - p)) + sum((c * float(w) for c, w in zip(parts, weight)), F.lit(0.0))
    # "of 12." may be a sentence's end or half a number: how many of the cut texts at limits and of all whole texts end so
    half = math.log((n_half + 0.5) / (n_cut + n_half + 1)) - math.log((n_decimal + 0.5) / (n_texts + 1))
    numbers = ends.where("kind = 'decimal'").join(hist, ["source", "len"], "left")
    lost = F.col("posterior") * F.col("n_open")
    numbers = numbers.select("_rec", "source", "len", "kind", F.when(lost > 0, F.log(lost / (F.col("n_closed") + F.col("n_open") - lost)) + half).alias("score"))
    rest = ends.where("kind = 'closed'").select("_rec", "source", "len", "kind", F.lit(None).cast("double").alias("score"))
    out = rest.unionByName(numbers).unionByName(rows.select("_rec", "source", "len", "kind", score.alias("score")))
    return out.withColumnRenamed("_rec", record)


def truncation_rates(df: DataFrame, column: str, record: str, source: str) -> DataFrame:
    """Per source: texts, cut texts and their share."""
    t = truncated(df, column, record, source)
    return t.groupBy(F.col("source").alias(source)).agg(F.count("*").alias("n_texts"), F.count(F.when(F.col("score") > 0, 1)).alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_texts"))
