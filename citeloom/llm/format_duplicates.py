"""Duplicates hidden by formatting differences.

A value is cut into the parts that are set off from each other, each normalised to its lower-cased letters and digits. Records of
one layout, the same parts in the same order, are counted first, exactly and by partial aggregates, so all that follows is done
once for each layout. Each part is hashed together with the name of its field and the hashes are added, so the fingerprint of a
layout doesn't depend on the order of its parts. Layouts are grouped by fingerprint and compared with the first of their group,
part by part and without sorting; those that differ (a collision) are compared among themselves in the same way.

Two titles are also the same if their letters and digits agree in order, whatever stands between them, so one with lost or
added separators joins the group of the others: the classes are the connected components over equal fingerprints and letters.

Defined results: NULL is no case; a value without any letter or digit equals only others without any; a record without copies
is its own class of size 1; repeated rows count as copies; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.graph import connected
from citeloom.operators.skew import join_class
from citeloom.session import checkpointed

#: What sets the parts of a title off from each other.
PART_BREAKS = "|•;/"
#: Between the parts of a layout; no letter or digit.
SEAM = "|"


def layout_of(value: Column) -> Column:
    """Normalised parts in their order, empty ones left out, in one text."""
    marked = F.translate(F.regexp_replace(F.lower(value), rf"[^\p{{L}}\p{{N}}{PART_BREAKS}]+", ""), PART_BREAKS, SEAM * len(PART_BREAKS))
    return F.btrim(F.regexp_replace(marked, r"\|{2,}", SEAM), F.lit(SEAM))


def parts_of(layout: Column) -> Column:
    return F.when(layout == "", F.array().cast("array<string>")).otherwise(F.split(layout, r"\|"))


def fingerprint(field: str, parts: Column) -> Column:
    """128 bits of a commutative multiset hash: four sums of independent 32-bit hashes of (field, part), which never overflow."""

    def total(salt: str) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + F.xxhash64(F.lit(salt + field), p).bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.struct(F.xxhash64(F.size(parts), total("a"), total("b")).alias("x"), F.xxhash64(F.size(parts), total("c"), total("d")).alias("y"))


def same_parts(a: Column, b: Column) -> Column:
    """Multiset equality without sorting: each part is as frequent in the one as in the other."""
    n = lambda arr, p: F.size(F.filter(arr, lambda x: x == p))
    return (a == b) | ((F.size(a) == F.size(b)) & F.forall(F.array_distinct(a), lambda p: n(a, p) == n(b, p)))


def _by_fingerprint(layouts: DataFrame, column: str) -> DataFrame:
    """(a, b): pairs of layouts with the same parts, each with the first of its group."""
    f = layouts.select("_id", "_layout", fingerprint(column, parts_of(F.col("_layout"))).alias("_f"))
    several = f.groupBy("_f").agg(F.count("*").alias("_n")).where("_n > 1").select("_f")
    left = checkpointed(f.join(several, "_f", "left_semi"))
    edges = None
    while not left.isEmpty():
        model = left.groupBy("_f").agg(F.min("_id").alias("_model"))
        model = model.join(left.select(F.col("_id").alias("_model"), F.col("_layout").alias("_as")), "_model").select("_f", "_model", "_as")
        held = left.join(model, "_f").withColumn("_same", same_parts(parts_of(F.col("_layout")), parts_of(F.col("_as"))))
        held = checkpointed(held)
        found = held.where("_same and _id <> _model").select(F.col("_id").alias("a"), F.col("_model").alias("b"))
        edges = found if edges is None else edges.unionByName(found)
        left = held.where("not _same").select("_id", "_layout", "_f")  # collisions
    return layouts.select(F.col("_id").alias("a"), F.col("_id").alias("b")).where("false") if edges is None else edges


def format_classes(df: DataFrame, column: str, record: str) -> tuple[DataFrame, DataFrame, int]:
    """(rows with their layout's id, one row per layout with the first record and size of its class, number of rows)."""
    rows = df.select(F.col(record).alias("_rec"), F.col(column).alias("_v")).where(F.col("_v").isNotNull()).select("_rec", layout_of(F.col("_v")).alias("_layout"))
    layouts = rows.groupBy("_layout").agg(F.min("_rec").alias("_first"), F.count("*").alias("_rows"))
    layouts = checkpointed(layouts.withColumn("_id", F.md5("_layout")))

    # the same letters: the layouts of a text without its seams
    letters = layouts.select("_id", F.md5(F.replace("_layout", F.lit(SEAM), F.lit(""))).alias("_l"))
    least = letters.groupBy("_l").agg(F.min("_id").alias("b"), F.count("*").alias("_n")).where("_n > 1")
    edges = letters.join(least, "_l").select(F.col("_id").alias("a"), "b").unionByName(_by_fingerprint(layouts, column))
    members = layouts.drop("_layout").join(connected(edges).withColumnRenamed("node", "_id"), "_id", "left").withColumn("_c", F.coalesce("root", "_id"))
    classes = members.groupBy("_c").agg(F.min("_first").alias("_a"), F.sum("_rows").alias("_copies"))
    per_layout = checkpointed(members.join(classes, "_c").select("_id", "_c", "_rows", "_a", "_copies"))
    total = per_layout.agg(F.sum("_rows")).first()[0] or 0
    return rows.select("_rec", F.md5("_layout").alias("_id")), per_layout, total


def format_duplicates(df: DataFrame, column: str, record: str) -> DataFrame:
    """One row per class of equal records: its first record and number of copies."""
    _, per_layout, _ = format_classes(df, column, record)
    return per_layout.groupBy("_c").agg(F.min("_a").alias(record), F.max("_copies").alias("copies")).drop("_c")


def duplicate_rows(df: DataFrame, column: str, record: str) -> DataFrame:
    """(record_a, record_b): the first record of a class and each further one."""
    rows, per_layout, total = format_classes(df, column, record)
    dup = per_layout.where(F.col("_copies") > 1).select("_id", "_a", "_rows")
    return join_class(rows, dup, "_id", "_rows", total).where(F.col("_rec") != F.col("_a")).select(F.col("_a").alias(f"{record}_a"), F.col("_rec").alias(f"{record}_b"))
