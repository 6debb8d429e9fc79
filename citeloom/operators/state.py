"""Ordered state: counters with resets, streaks, stop rules, latest state of a log.

A key may hold a large share of all rows, so counters are computed within chunks of a key (its files, and parts of long ones) and
then carried over the chunks by a window over one summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import checkpointed

#: Most positions of one chunk of a key.
CHUNK = 50_000


def counters(df: DataFrame, key: str, chunk: str, order: str, rules: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """The value of each counter after each row, in the order (chunk, order) within a key; every key starts at zero.

    rules: for each counter what a row adds, and what it sets the counter to (NULL or None: nothing). Rows are read once; the place
    of the last reset needs no island, as the value is the sum of all additions and of what the last reset took away or gave.
    NULL additions are 0; rows of a NULL key are counted together; ``order`` is numeric.
    """
    zero = F.lit(0).cast("long")
    work = df.withColumn("_p", F.floor(F.col(order) / CHUNK))
    for i, (add, reset) in enumerate(rules.values()):
        to = (F.lit(None) if reset is None else reset).cast("long")
        work = work.withColumns({f"_r{i}": to, f"_a{i}": F.when(to.isNull(), F.coalesce(add.cast("long"), zero)).otherwise(zero)})
    n = range(len(rules))
    w = Window.partitionBy(key, chunk, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumns({f"_c{i}": F.sum(f"_a{i}").over(w) for i in n})
    work = work.withColumns({f"_b{i}": F.last(F.col(f"_r{i}") - F.col(f"_c{i}"), ignorenulls=True).over(w) for i in n}).drop(*[f"_{x}{i}" for x in "ra" for i in n])
    work = checkpointed(work)  # read for the summaries and for the rows

    per = work.groupBy(key, chunk, "_p").agg(F.max_by(F.struct(*[f"_{x}{i}" for x in "cb" for i in n]), order).alias("_l")).select(key, chunk, "_p", "_l.*")
    by = Window.partitionBy(key).orderBy(chunk, "_p")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    # a chunk with a reset sets the counter to its own last value, one without adds to it
    per = per.withColumns({f"_s{i}": F.sum(F.when(F.col(f"_b{i}").isNull(), F.col(f"_c{i}")).otherwise(0)).over(upto) for i in n})
    per = per.withColumns({f"_t{i}": F.last(F.col(f"_c{i}") + F.col(f"_b{i}") - F.col(f"_s{i}"), ignorenulls=True).over(upto) for i in n})
    carry = per.select(key, chunk, "_p", *[F.coalesce(F.lag(F.col(f"_s{i}") + F.coalesce(f"_t{i}", zero)).over(by), zero).alias(f"_k{i}") for i in n])
    pair = (work[key].eqNullSafe(carry[key])) & (work[chunk].eqNullSafe(carry[chunk])) & (work["_p"].eqNullSafe(carry["_p"]))
    out = work.join(carry, pair).drop(carry[key], carry[chunk], carry["_p"])
    values = {name: F.col(f"_c{i}") + F.coalesce(f"_b{i}", f"_k{i}") for i, name in enumerate(rules)}
    return out.withColumns(values).drop("_p", *[f"_{x}{i}" for x in "cbk" for i in n])


def streak(flag: Column) -> tuple[Column, Column]:
    """Rule of a run of true rows."""
    return F.lit(1), F.when(F.coalesce(flag, F.lit(False)), F.lit(None)).otherwise(0)


def stop_rows(df: DataFrame, key: str, order: list[str], counters: list[str], any_above: int, sum_above: int) -> DataFrame:
    """First row of each key at which one counter or their sum is too high; keys that never stop have none."""
    hit = F.lit(False)
    for c in counters:
        hit = hit | (F.col(c) > any_above)
    hit = hit | (sum((F.col(c) for c in counters), F.lit(0)) > sum_above)
    return df.where(hit).groupBy(key).agg(F.min(F.struct(*order)).alias("_o")).select(key, "_o.*")


def latest_state(events: DataFrame, key: str, status: str, time: str, tie: str) -> DataFrame:
    """Last status of each key by event time, whatever the order of loading; NULL times never win over others."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(status, F.struct(time, tie, status)).alias(status), F.max(time).alias(time))


def status_code(c: Column) -> Column:
    """One spelling for each status."""
    low = F.lower(c)
    return F.when(low.isin("1", "true"), "done").when(low.isin("0", "false"), "open").when(low == "404", "gone").when(c.isNotNull(), "unknown")
