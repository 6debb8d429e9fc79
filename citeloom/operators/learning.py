"""Fit and transform: encoders, truncated SVD, resampling, ridge, cross validation and boosted trees.

What is collected is a k x k matrix, or one row a feature while the features are few; never rows of papers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators import text as X
from citeloom.operators.relational import row_positions
from citeloom.session import checkpointed

#: Up to so many features a thin matrix is multiplied on the executors from a broadcast; with more it is a table and is joined.
BROADCAST_FEATURES = 250_000
#: Most passes of the subspace iteration, and the change of the singular values at which it ends.
PASSES, SETTLED = 60, 1e-7
#: Most rounds of boosting, and rounds without a lower error on held rows after which it stops.
ROUNDS, PATIENCE = 100, 15


@dataclass
class Encoder:
    """Fitted vocabulary (field, term, df, index) without any bound but the thresholds, and the variants of title words."""

    vocabulary: DataFrame
    lemmas: DataFrame
    size: int


def fit_encoder(papers: DataFrame, min_df: dict[str, int] = X.MIN_DF) -> Encoder:
    """papers: as in raw_features. Features are numbered in the order of field and term."""
    raw = checkpointed(X.raw_features(papers))
    lemmas = checkpointed(X.title_lemmas(raw))
    vocabulary = row_positions(X.frequent(X.with_lemmas(raw, lemmas), min_df), [F.asc("field"), F.asc("term")], "index")
    vocabulary = checkpointed(vocabulary.withColumn("index", F.col("index").cast("int")))
    return Encoder(vocabulary, lemmas, vocabulary.count())


def encode(papers: DataFrame, encoder: Encoder, keep: list[str]) -> DataFrame:
    """``keep`` and (indices, values) of the features of each paper; unseen terms are ignored, a paper may have none.

    What is gathered in a row are the features of one paper.
    """
    seen = X.with_lemmas(X.raw_features(papers), encoder.lemmas).join(encoder.vocabulary.select("field", "term", "index"), ["field", "term"])
    rows = seen.groupBy(F.col("doc_id").alias("row_id")).agg(F.array_sort(F.collect_list("index")).alias("indices"))
    out = papers.select("row_id", *[c for c in keep if c != "row_id"]).join(rows, "row_id", "left")
    indices = F.coalesce("indices", F.array().cast("array<int>"))
    return out.withColumn("indices", indices).withColumn("values", F.transform("indices", lambda _: F.lit(1.0)))


def _times(index: pd.Series, value: pd.Series, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows times a matrix, with the flat indices, values and row numbers."""
    size = np.array([len(x) for x in index], dtype=int)
    flat = np.concatenate([np.asarray(x, dtype=int) for x in index]) if size.sum() else np.zeros(0, int)
    x = np.concatenate([np.asarray(v, dtype=float) for v in value]) if size.sum() else np.zeros(0)
    row = np.repeat(np.arange(len(size)), size)
    out = np.stack([np.bincount(row, m[flat, j] * x, minlength=len(size)) for j in range(m.shape[1])], axis=1) if len(flat) else np.zeros((len(size), m.shape[1]))
    return out, flat, x, row


def _top(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and the directions within the subspace, greatest first."""
    w, u = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(-w)[:k]
    return np.sqrt(np.maximum(w[order], 0)), u[:, order]


def _settled(s: np.ndarray, last: np.ndarray | None) -> bool:
    return last is not None and bool(np.all(np.abs(s - last) <= SETTLED * max(float(s[0]) if len(s) else 0.0, 1e-300)))


def truncated_svd(df: DataFrame, n: int, k: int, passes: int = PASSES, extra: int = 8, seed: int = 7, broadcast: int = BROADCAST_FEATURES) -> tuple[np.ndarray, np.ndarray | DataFrame]:
    """Singular values and right vectors of rows (indices, values), uncentred; each vector's largest entry is positive.

    A block Krylov space grows until the singular values settle; exact at once for n up to 256. The vectors are an array (n x k),
    or with more than ``broadcast`` features a table (index, v0, v1, ...), found by iterating one block.
    """
    if n > broadcast:
        return _joined_svd(df, k, passes, extra, seed)
    exact = n <= 256
    q = np.eye(n) if exact else np.linalg.qr(np.random.default_rng(seed).normal(size=(n, k + extra)))[0]
    s = last = u = None
    basis, images = np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(1 if exact else passes):
        shared, width = df.sparkSession.sparkContext.broadcast(q), q.shape[1]

        def run(batches, shared=shared, width=width):
            z = np.zeros((n, width))
            for b in batches:
                y, flat, x, row = _times(b["indices"], b["values"], shared.value)
                for j in range(width):
                    z[:, j] += np.bincount(flat, y[row, j] * x, minlength=n)[:n]
            at = np.flatnonzero(z.any(axis=1))
            yield pd.DataFrame({"f": at.astype("int32"), **{f"c{j}": z[at, j] for j in range(width)}})

        names = [f"c{j}" for j in range(width)]
        parts = df.select("indices", "values").mapInPandas(run, "f int, " + ", ".join(f"{c} double" for c in names))
        z = np.zeros((n, width))
        got = parts.groupBy("f").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
        z[got["f"].to_numpy()] = got[names].to_numpy()
        basis, images = np.hstack([basis, q]), np.hstack([images, z])
        s, u = _top(basis.T @ images, k)
        if exact or _settled(s, last):
            break
        last = s
        for _ in range(2):  # once more for what rounding leaves
            z = z - basis @ (basis.T @ z)
        q, r = np.linalg.qr(z)
        q = q[:, np.abs(np.diag(r)) > 1e-10 * max(float(s[0]) ** 2, 1e-300)]  # directions that are not in the space yet
        if not q.shape[1]:
            break
    v = basis @ u
    return s, v * np.where(v[np.abs(v).argmax(axis=0), range(v.shape[1])] < 0, -1, 1)


def _joined_svd(df: DataFrame, k: int, passes: int, extra: int, seed: int) -> tuple[np.ndarray, DataFrame]:
    """The same iteration with the thin matrix as a table of one row a feature; only its k x k products come to the driver."""
    rows = df.select("indices", "values").withColumn("r", F.monotonically_increasing_id())  # before they are taken apart
    row = rows.select("r", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    entries = checkpointed(row.select("r", F.col("e.indices").alias("index"), F.col("e.values").alias("x")))
    width = k + extra
    c = [f"c{j}" for j in range(width)]

    def product(t: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
        sums = t.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)) for a in left for b in right]).first()
        return np.array(sums, float).reshape(len(left), len(right))

    def times(t: DataFrame, m: np.ndarray, out: list[str], keep: list[str]) -> DataFrame:
        return t.select(*keep, *[sum((F.col(a) * float(m[i, j]) for i, a in enumerate(c)), F.lit(0.0)).alias(o) for j, o in enumerate(out)])

    def orthonormal(t: DataFrame) -> DataFrame:
        for _ in range(2):  # once more for what the first leaves
            w, u = np.linalg.eigh(product(t, c, c))
            t = times(t, u * np.where(w > 1e-12 * max(w.max(), 1e-300), 1 / np.sqrt(np.maximum(w, 1e-300)), 0), c, ["index"])
        return checkpointed(t)

    unit = lambda j: F.xxhash64(F.lit(seed), F.lit(j), "index") / F.lit(float(2**63))
    q = orthonormal(entries.select("index").distinct().select("index", *[unit(j).alias(x) for j, x in enumerate(c)]))
    s = last = u = None
    for _ in range(passes):
        y = entries.join(q, "index").groupBy("r").agg(*[F.sum(F.col("x") * F.col(x)).alias(x) for x in c])
        z = checkpointed(entries.join(y, "r").groupBy("index").agg(*[F.sum(F.col("x") * F.col(x)).alias(x) for x in c]))
        both = q.join(z.select("index", *[F.col(x).alias(f"z{x}") for x in c]), "index")
        before, (s, u) = q, _top(product(both, c, [f"z{x}" for x in c]), k)
        if _settled(s, last):
            break
        last, q = s, orthonormal(z)
    names = [f"v{j}" for j in range(k)]
    v = checkpointed(times(before, u, names, ["index"]))
    peak = v.agg(*[F.max_by(x, F.struct(F.abs(F.col(x)), -F.col("index"))) for x in names]).first()
    return s, v.select("index", *[(F.col(x) * (-1.0 if (p or 0) < 0 else 1.0)).alias(x) for x, p in zip(names, peak)])


def project(df: DataFrame, v: np.ndarray | DataFrame, out: str = "components", key: str = "row_id") -> DataFrame:
    """Multiply rows (indices, values) by the right vectors, from a broadcast or, if they are a table, by a join over the key."""
    if isinstance(v, DataFrame):
        names = [x for x in v.columns if x != "index"]
        e = df.select(key, F.explode(F.arrays_zip("indices", "values")).alias("e")).select(key, F.col("e.indices").alias("index"), F.col("e.values").alias("x"))
        y = e.join(v, "index").groupBy(key).agg(*[F.sum(F.col("x") * F.col(x)).alias(x) for x in names])
        zero = F.array(*[F.coalesce(x, F.lit(0.0)) for x in names])
        return df.drop("indices", "values").join(y, key, "left").withColumn(out, zero).drop(*names)
    shared = df.sparkSession.sparkContext.broadcast(v)

    @F.pandas_udf("array<double>")
    def times(index: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series(list(_times(index, value, shared.value)[0]))

    return df.withColumn(out, times("indices", "values")).drop("indices", "values")


def oversample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Rows of the smaller class repeated until both classes have the same number; the surplus goes to the first keys."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(counts) != 2:
        return df
    small, large = min(counts, key=counts.get), max(counts, key=counts.get)
    times, more = divmod(counts[large], counts[small])
    few = row_positions(df.where(F.col(label) == small), [F.asc(key)], "_at")
    copies = few.withColumn("_n", F.lit(times) + (F.col("_at") < more).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return df.where(F.col(label) == large).unionByName(copies.drop("_at", "_n", "_c"))


def resampled_ridge(train: DataFrame, components: str, k: int, label: str, key: str, alpha: float) -> np.ndarray:
    """Ridge fitted on the resampled training rows; what is scored later is never resampled."""
    return ridge_fit(oversample(train, label, key), components, k, label, alpha)


def gram(df: DataFrame, components: str, k: int, target: Column, group: Column | None = None) -> dict:
    """X'X (with a constant) and X'y, per group, in one aggregation of k^2 sums."""
    x = [F.get(F.col(components), F.lit(i)) for i in range(k)] + [F.lit(1.0)]
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)] + [F.sum(x[i] * target).alias(f"y{i}") for i in range(k + 1)]
    rows = df.groupBy((group if group is not None else F.lit(0)).alias("_g")).agg(*sums).collect()
    out = {}
    for r in rows:
        a = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i, k + 1):
                a[i, j] = a[j, i] = r[f"g{i}_{j}"]
        out[r["_g"]] = (a, np.array([r[f"y{i}"] for i in range(k + 1)]))
    return out


def ridge_solve(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """Weights and constant; the constant is not penalised."""
    penalty = alpha * np.eye(len(b))
    penalty[-1, -1] = 0
    return np.linalg.solve(a + penalty, b)


def ridge_fit(df: DataFrame, components: str, k: int, label: str, alpha: float) -> np.ndarray:
    """Ridge on labels -1 and +1, exact by normal equations."""
    a, b = gram(df, components, k, F.when(F.col(label) == 1, 1.0).otherwise(-1.0))[0]
    return ridge_solve(a, b, alpha)


def ridge_score(df: DataFrame, components: str, w: np.ndarray, out: str = "score") -> DataFrame:
    s = F.lit(float(w[-1]))
    for i, x in enumerate(w[:-1]):
        s = s + F.get(F.col(components), F.lit(i)) * float(x)
    return df.withColumn(out, s)


def auc(df: DataFrame, score: str, label: str) -> float:
    """Area under the ROC curve by mid-ranks of distinct scores, from counts per score."""
    per = df.groupBy(F.round(score, 9).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    pos = row_positions(per.withColumn("q", F.col("n") - F.col("p")), [F.asc("s")], "_at", {"_before": F.col("q")})
    r = pos.agg(F.sum(F.col("p") * (F.col("_before") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    return float(r["u"]) / (r["p"] * r["q"]) if r["p"] and r["q"] else float("nan")


def folds(df: DataFrame, label: str, key: str, n: int = 3) -> DataFrame:
    """Stratified folds: the place within a class modulo n."""
    out = None
    for value in (0, 1):
        part = row_positions(df.where(F.col(label) == value), [F.asc(key)], "_at").withColumn("fold", (F.col("_at") % n).cast("int")).drop("_at")
        out = part if out is None else out.unionByName(part)
    return out


def cv_search(df: DataFrame, components: str, k: int, label: str, key: str, alphas: tuple[float, ...] = (1.0, 10.0, 100.0, 1000.0), n: int = 3) -> list[tuple[float, int, float]]:
    """(alpha, fold, AUC) for every point of the grid; the sums of each fold are taken once and the other folds' sums added up."""
    df = folds(df, label, key, n)
    sums = gram(df, components, k, F.when(F.col(label) == 1, 1.0).otherwise(-1.0), F.col("fold"))
    out = []
    for alpha in alphas:
        for f in range(n):
            a = sum(sums[g][0] for g in sums if g != f)
            b = sum(sums[g][1] for g in sums if g != f)
            w = ridge_solve(a, b, alpha)
            out.append((alpha, f, auc(ridge_score(df.where(F.col("fold") == f), components, w), "score", label)))
    return out


def best_round(errors: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Rounds up to the least error, and whether as many as `patience` without a lower one followed; later rounds don't count."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def boosted(gbt, train: DataFrame, held: DataFrame, *loss: str):
    """Boosting stopped early by the loss on held rows, with patience; the validation column of Spark stops at the first round without gain.

    Rounds don't depend on how many follow, so a longer fit starts with those of a shorter one and the best are fitted again.
    """
    if held.isEmpty():
        return gbt.setMaxIter(ROUNDS).fit(train)
    rounds = PATIENCE + 10
    while True:
        model = gbt.setMaxIter(rounds).fit(train)
        best, stopped = best_round(list(model.evaluateEachIteration(held, *loss)))
        if stopped or rounds == ROUNDS:
            return model if best == rounds else gbt.setMaxIter(best).fit(train)
        rounds = min(ROUNDS, 2 * rounds)


def gbt_classifier(train: DataFrame, held: DataFrame, components: str, label: str) -> GBTClassificationModel:
    g = GBTClassifier(featuresCol="features", labelCol=label, maxDepth=3, seed=7)
    return boosted(g, *(x.withColumn("features", array_to_vector(components)) for x in (train, held)))


def gbt_regressor(train: DataFrame, held: DataFrame, components: str, target: str) -> GBTRegressionModel:
    """Boosted trees on the logarithm of the target plus one, so the squared error is that of logs."""
    g = GBTRegressor(featuresCol="features", labelCol="_y", maxDepth=3, seed=7)
    return boosted(g, *(x.withColumn("features", array_to_vector(components)).withColumn("_y", F.log1p(target)) for x in (train, held)), "squared")
