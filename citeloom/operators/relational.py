"""Joins, aggregates, ordered operators and set operations of the pipeline, as DataFrame to DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import columns as C
from citeloom.functions.language import language
from citeloom.session import checkpointed


def dedup_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key in a defined order; an aggregate of whole rows, so duplicates are dropped before the shuffle and a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def clean_papers(raw: DataFrame) -> DataFrame:
    """Deduplicated English papers with date, citations and citations a year; rows without a rate of at least 0 are dropped.

    The language test depends only on the key, so it runs before the shuffle.
    """
    keep = ["titleid", "title_main", "authors", "journal", "conference", "source", "book", "publisher", "vol", "issue", "pages", "pubdate", "cited", "scrap_auth_id", "urlid", "row_id", "_file", "_pos"]
    df = raw.select(*keep).where(F.col("titleid").isNotNull() & (language(F.col("titleid")) == "en"))
    df = dedup_first(df, ["titleid"], ["_file", "_pos"])
    text = [c for c in keep if c not in ("titleid", "cited", "row_id", "_file", "_pos")]
    df = df.withColumns({"cited_num": C.cited_number(F.col("cited")), **{c: C.unmarked(F.col(c)) for c in text}})
    df = df.withColumns({"year": C.year_text(F.col("pubdate")), "date": C.parse_date(F.col("pubdate"))})
    return df.withColumn("cites_per_year", C.rate(F.col("cited_num"), C.years_since(F.col("date")))).where(F.col("cites_per_year") >= 0).drop("pubdate", "cited", "_file", "_pos")


def left_lookup(df: DataFrame, lookup: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Value of a key from a lookup of unique keys, or a default. Catalyst broadcasts the lookup only where its size is known to be small."""
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def exists_flag(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """1 where the key is in the other table; one join for the whole batch."""
    return df.join(other.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left").withColumn("found", F.coalesce("_hit", F.lit(0))).drop("_hit")


def anti_new(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored yet."""
    return df.join(stored.select(key), key, "left_anti")


#: Values of a key that are joined at once; more are joined in blocks of so many.
BLOCK = 1000


def group_concat(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Values of a key in a defined order, joined by spaces, duplicates kept; a long list is joined in blocks, so that only the
    result itself is ever in one row."""
    at = group_positions(df, key, order, "_n").withColumn("_b", F.floor(F.col("_n") / BLOCK))
    joined = lambda items: F.concat_ws(" ", F.transform(F.array_sort(items), lambda x: x["_v"]))
    blocks = at.groupBy(key, "_b").agg(joined(F.collect_list(F.struct("_n", F.col(value).alias("_v")))).alias("_v"))
    return blocks.groupBy(key).agg(joined(F.collect_list(F.struct("_b", "_v"))).alias(value))


def topic_share(pairs: DataFrame, group: str, item: str, hit: Column, threshold: float) -> DataFrame:
    """Groups in which more than a share of the distinct items hits; repeats of an item count once."""
    per = pairs.groupBy(group).agg(F.countDistinct(item).alias("n_items"), F.countDistinct(F.when(hit, F.col(item))).alias("n_hits"))
    return per.withColumn("share", F.try_divide(F.col("n_hits"), F.col("n_items"))).where(F.col("share") > threshold)


def doc_frequency(tokens: DataFrame, doc: str, term: str, min_df: int = 1) -> DataFrame:
    return tokens.groupBy(term).agg(F.countDistinct(doc).alias("df")).where(F.col("df") >= min_df)


def missing_fraction(df: DataFrame, fields: list[str], limit: float = 0.4) -> DataFrame:
    n = sum((C.missing_flag(F.col(c)) for c in fields), F.lit(0))
    return df.withColumn("n_missing", n).withColumn("mostly_missing", (n / F.lit(float(len(fields))) > limit).cast("int"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal-width bins; values outside are left out, the upper end belongs to the last bin."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, low: float, high: float, bins: int) -> DataFrame:
    width = (high - low) / bins
    at = lambda c: F.least(F.floor((F.col(c) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(x).between(low, high) & F.col(y).between(low, high)).groupBy(at(x).alias("bin_x"), at(y).alias("bin_y")).agg(F.count("*").alias("n"))


def row_positions(df: DataFrame, order: list[Column], name: str = "position", ahead: dict[str, Column] | None = None) -> DataFrame:
    """0-based positions in a total order without a single sorting task: range partitions, their sizes, and the place within each.

    ahead: names of sums over all rows before each row, with what is added up.
    """
    sums = {name: F.lit(1).cast("long"), **(ahead or {})}
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    part = checkpointed(df.withColumns(values).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}o") for v in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumns({f"{v}i": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(F.broadcast(offsets), "_part")
    return part.withColumns({n: F.col(f"{v}o") + F.col(f"{v}i") for n, v in zip(sums, values)}).drop("_part", *values, *[f"{v}{x}" for v in values for x in "oi"])


def group_positions(df: DataFrame, key: str, order: list[str], name: str = "position") -> DataFrame:
    """0-based place of each row among those of its key, however many; no key is ever in one task."""
    at = checkpointed(row_positions(df, [F.asc(key), *[F.asc(c) for c in order]], "_at"))
    return at.join(at.groupBy(key).agg(F.min("_at").alias("_first")), key).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first")


#: Ranks on either side of a quantile that are sorted; the approximate quantile is closer than that.
MARGIN = 2e-4


def top_quantile(df: DataFrame, value: str, tie: str, q: float) -> DataFrame:
    """Rows with the greatest values, as many as half-even rounding of n * q says.

    An approximate quantile bounds the k-th value from both sides; what is above is counted and only what lies between the bounds
    is sorted. df should be cheap to read again.
    """
    around = [min(1.0, max(0.0, 1 - q + s * MARGIN)) for s in (-1, 1)]
    n, bounds = df.agg(F.count("*"), F.percentile_approx(value, around, 20_000)).first()
    k = int(round(n * q))
    if not k:
        return df.where("false")
    low, high = bounds
    above, near = df.where(F.col(value) > high), df.where(F.col(value).between(low, high))
    counts = df.agg(F.count(F.when(F.col(value) > high, 1)), F.count(F.when(F.col(value) >= low, 1))).first()
    if not counts[0] <= k <= counts[1]:  # NULL values among the greatest, or a bound that was off
        return row_positions(df, [F.desc(value), F.asc(tie)], "_at").where(F.col("_at") < k).drop("_at")
    return above.unionByName(row_positions(near, [F.desc(value), F.asc(tie)], "_at").where(F.col("_at") < k - counts[0]).drop("_at"))


def quantile_overlap(df: DataFrame, pred: str, actual: str, key: str, q: float = 0.05) -> DataFrame:
    """Share of the rows greatest by ``actual`` that are also among those greatest by ``pred``."""
    df = checkpointed(df.select(key, pred, actual))  # read by both
    a, p = top_quantile(df, actual, key, q), top_quantile(df, pred, key, q)
    n = a.count()
    return a.join(p.select(key), key, "left_semi").agg(F.count("*").alias("n_both")).select("n_both", F.lit(n).cast("long").alias("n_top"), F.try_divide(F.col("n_both"), F.lit(n)).alias("share"))


def class_metrics(df: DataFrame) -> DataFrame:
    """Of labels y and predictions p (0 or 1): precision, recall, F1 and support of both classes, beside accuracy and the means.

    A class that is never predicted or never there has no precision or recall; it counts as 0 in the means.
    """
    n = df.groupBy("y", "p").agg(F.count("*").alias("n"))  # four rows at most
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("class")
    count = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    c = F.col("class")
    per = n.select(k, "y", "p", "n").groupBy("class").agg(
        count((F.col("y") == c) & (F.col("p") == c)).alias("tp"), count(F.col("p") == c).alias("np"), count(F.col("y") == c).alias("support"), F.try_divide(count(F.col("y") == F.col("p")), F.sum("n")).alias("accuracy")
    )
    per = per.select("class", F.try_divide(F.col("tp"), F.col("np")).alias("precision"), F.try_divide(F.col("tp"), F.col("support")).alias("recall"), F.try_divide(F.col("tp") * 2.0, F.col("np") + F.col("support")).alias("f1"), "support", "accuracy")
    means = [F.avg(F.coalesce(x, F.lit(0.0))).over(Window.partitionBy(F.lit(0))).alias(f"macro_{x}") for x in ("precision", "recall", "f1")]
    return per.select("*", *means)


def last_writer(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in which the later one wins per key."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_w", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (key, "_w")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "_w").alias("_r")).select(key, "_r.*")


def split_by_date(df: DataFrame, date: str, first_test: str) -> DataFrame:
    """Marks train and test by a predicate, so the parts are disjoint and complete; NULL dates are in neither."""
    return df.withColumn("part", F.when(F.col(date) < F.lit(first_test).cast("date"), "train").when(F.col(date).isNotNull(), "test"))


def shuffled_match(df: DataFrame, key: str, value: str, seed: int = 11) -> DataFrame:
    """A null model: every row gets the value of another, by the order of a seeded hash of the key; same multiset of values."""
    order = row_positions(df.select(key, value), [F.asc(key)], "_i").select(key, "_i")
    mixed = row_positions(df.select(F.col(key).alias("_k"), F.col(value).alias(f"{value}_shuffled")), [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_k"))).asc(), F.asc("_k")], "_i").select("_i", f"{value}_shuffled")
    return df.join(order.join(mixed, "_i").drop("_i"), key)


def sample_one(df: DataFrame, key: str, seed: int = 11) -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))), key).limit(1)
