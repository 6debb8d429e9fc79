"""Mixing sources to target weights.

Every source is a stream of its texts in the order of a seeded hash, started again for each repeat, and is cut into blocks of
whole texts: a text belongs to the block in which it begins. A source of weight w has its block of the tokens [a, b) of its
stream released when the mixture has a / w tokens, with b / w as its deadline; earliest deadline first among the released
blocks then gives the block of each slot. A long text pays for the room it takes, so at no slot a source is further from its
share than one block, the largest that there is: at most the pitch of the blocks and the longest text (``largest_deviation``).

The number of blocks is a parameter that bounds the schedule, made on the driver; texts never leave the executors. Places in a
stream are prefix sums in two levels, over buckets of the hash and within them, so no source is ever in one task.

Defined results: NULL and empty texts have no size and are left out; sources without a target or without texts contribute
nothing and the report says so; equal hashes are ordered by id, repeated rows are texts of their own; empty tables give empty
results.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.tokens import VOCABULARY, token_counts
from citeloom.session import bounded_rows, checkpointed

MAX_SOURCES = 10_000
MAX_BLOCKS = 32_768
MIN_BLOCK = 1024
BUCKET_ROWS = 50_000


def quotas(targets: list[tuple[str, float, int]], sizes: dict[str, int], total: int | str = "exact") -> dict[str, float]:
    """Tokens to take from each source.

    total: ``exact`` takes the largest mixture in which every source with texts reaches its share; ``corpus`` or a number fixes
    the size, sources that can't fill their share even when repeated then give what they have and the others fill up in proportion.
    """
    live = [(s, w, max(1, r or 1) * sizes.get(s, 0)) for s, w, r in targets if w and w > 0 and sizes.get(s, 0) > 0]
    if not live:
        return {}
    weight = sum(w for _, w, _ in live)
    if total == "exact":
        t = min(cap * weight / w for _, w, cap in live)
        return {s: t * w / weight for s, w, _ in live}
    t = float(sum(sizes.values()) if total == "corpus" else total)
    out: dict[str, float] = {}
    while live:
        weight = sum(w for _, w, _ in live)
        short = [(s, cap) for s, w, cap in live if cap < t * w / weight]
        if not short:
            return out | {s: t * w / weight for s, w, _ in live}
        for s, cap in short:
            out[s] = float(cap)
            t -= cap
        live = [x for x in live if x[0] not in out]
    return out


def schedule(blocks: dict[str, list[tuple[int, int]]]) -> list[tuple[int, str, int]]:
    """(slot, source, block) by earliest deadline first among the released blocks; exact rational arithmetic.

    blocks: (block, tokens) of each source in order. The weight of a source is its share of all tokens. Some source is always no
    more than at its share, so a block is always released.
    """
    size = {s: sum(n for _, n in b) for s, b in blocks.items()}
    total, done = sum(size.values()), 0
    ahead = dict.fromkeys(blocks, 0)
    waiting: list[tuple[Fraction, Fraction, str, int]] = []  # release, deadline, source, place of the block
    ready: list[tuple[Fraction, str, int]] = []
    out: list[tuple[int, str, int]] = []

    def release(s: str, i: int) -> None:
        if i < len(blocks[s]):
            heapq.heappush(waiting, (Fraction(ahead[s] * total, size[s]), Fraction((ahead[s] + blocks[s][i][1]) * total, size[s]), s, i))

    for s in sorted(blocks):
        release(s, 0)
    while waiting or ready:
        while waiting and waiting[0][0] <= done:
            _, d, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (d, s, i))
        _, s, i = heapq.heappop(ready)
        block, n = blocks[s][i]
        out.append((len(out), s, block))
        ahead[s] += n
        done += n
        release(s, i + 1)
    return out


def mix(sizes: DataFrame, targets: DataFrame, item: str = "doc_id", total: int | str = "corpus", seed: int = 7, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(slot, source, repeat_no, item, tokens, source_start): the mixture, in order of slot and source_start.

    sizes: (item, source, tokens). targets: (source, target_share, max_repeats). total: as in quotas; by default as many tokens
    as the sources with a target have, so a small source lacks part of its share instead of shrinking the whole mixture.
    """
    spark = sizes.sparkSession
    want = [(r[0], float(r[1] or 0), r[2]) for r in bounded_rows(targets.select("source", "target_share", "max_repeats"), MAX_SOURCES, "targets") if r[0] is not None]
    names = spark.createDataFrame([(s,) for s, _, _ in want], "source string")
    live = checkpointed(sizes.where("tokens > 0").join(F.broadcast(names), "source", "left_semi").select(F.col(item).alias("item"), "source", F.col("tokens").cast("long").alias("tokens")))
    rows = live.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect()  # at most one row a target
    have = {r[0]: r[1] for r in rows}
    quota = quotas(want, have, total)
    # a quota is rounded to whole blocks only in the schedule; the texts are cut off at the quota itself
    pitch = max(MIN_BLOCK, math.ceil(sum(quota.values()) / max_blocks))
    facts = spark.createDataFrame([(s, float(q), int(have[s]), math.ceil(q / have[s] - 1e-9)) for s, q in quota.items()], "source string, quota double, size long, epochs int")
    buckets = max(1, math.ceil(sum(r[2] for r in rows) / BUCKET_ROWS))

    runs = live.join(F.broadcast(facts), "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.greatest("epochs", F.lit(1)))))
    runs = runs.withColumn("h", F.xxhash64(F.lit(seed), "repeat_no", "item")).withColumn("bucket", F.pmod(F.shiftright("h", 24), F.lit(buckets)))
    per = runs.groupBy("source", "repeat_no", "bucket").agg(F.sum("tokens").alias("_sum"))
    ahead = per.withColumn("before", F.coalesce(F.sum("_sum").over(Window.partitionBy("source", "repeat_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "repeat_no", "bucket").orderBy("h", "item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumn("_in", inside).join(ahead, ["source", "repeat_no", "bucket"]).withColumn("source_start", (F.col("repeat_no") - 1) * F.col("size") + F.col("before") + F.col("_in"))
    taken = placed.where("source_start < quota").withColumn("block", F.floor(F.col("source_start") / pitch))
    taken = checkpointed(taken.select("source", "block", "repeat_no", "item", "tokens", "source_start"))
    blocks: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in sorted(taken.groupBy("source", "block").agg(F.sum("tokens").alias("n")).collect()):  # at most max_blocks and one for each source
        blocks[r["source"]].append((r["block"], r["n"]))
    plan = spark.createDataFrame(schedule(blocks), "slot long, source string, block long")
    out = taken.join(F.broadcast(plan), ["source", "block"])
    return out.select("slot", "source", "repeat_no", F.col("item").alias(item), "tokens", "source_start")


def mix_texts(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, **options) -> DataFrame:
    sizes = token_counts(docs, text, [key, source], vocabulary).withColumnRenamed(source, "source")
    return mix(sizes, targets, key, **options)


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: its target, the tokens and share really reached, and the most repeats of a text."""
    per = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_texts"), F.max("repeat_no").alias("repeats"))
    total = per.agg(F.sum("tokens").alias("_all"))
    out = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").join(F.broadcast(total))
    got = F.coalesce("tokens", F.lit(0))
    return out.select("source", "target_share", "max_repeats", got.alias("tokens"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce(got / F.col("_all"), F.lit(0.0)).alias("actual_share"))


def largest_deviation(mixed: DataFrame) -> DataFrame:
    """Per source: the most tokens by which it is ever, between two slots, off its share of the mixture so far, and the largest block."""
    slots = mixed.groupBy("slot", "source").agg(F.sum("tokens").alias("n"))
    # one row a slot from here on, of which the schedule has a bounded number
    before = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.withColumns({"_t": before(F.lit(0)), "_e": before("source")})
    size, total, block = F.sum("n").over(Window.partitionBy("source")), F.sum("n").over(Window.partitionBy(F.lit(0))), F.max("n").over(Window.partitionBy(F.lit(0)))
    slots = slots.withColumns({"_w": size / total, "_b": block})
    off = F.greatest(F.abs(F.col("_e") - F.col("_w") * F.col("_t")), F.abs(F.col("_e") + F.col("n") - F.col("_w") * (F.col("_t") + F.col("n"))))
    per = slots.groupBy("source").agg(F.max(off).alias("deviation_tokens"), F.max("_b").alias("block_tokens"))
    return per.withColumn("deviation_blocks", F.col("deviation_tokens") / F.col("block_tokens"))
