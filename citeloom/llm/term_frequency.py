"""Frequency of every distinct value or term of a text column.

(term, record) pairs are sorted externally by range partitions of the pair, so that a term in a third of all rows is spread
over many tasks while each pair lands in one; a run-length scan over each sorted partition counts occurrences and distinct
records, and the few runs that a range border cuts are added up.

Defined results: NULL text has no terms and is no record of the total; an empty text is a value but has no words; repeated
rows with one record id count as one record and all their occurrences; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
RARE_BELOW = 20
COMMON_ABOVE = 0.1


def term_pairs(df: DataFrame, column: str, record: str) -> DataFrame:
    """(kind, term, record, n): the words of each row with their number in it, and the whole value."""
    words = F.regexp_extract_all(F.lower(F.col("_text")), F.lit(WORD), F.lit(0))
    base = df.select(F.col(column).alias("_text"), F.col(record).alias("_rec")).where(F.col("_text").isNotNull())
    both = F.concat(F.array(F.struct(F.lit("value").alias("kind"), F.col("_text").alias("term"))), F.transform(words, lambda w: F.struct(F.lit("word").alias("kind"), w.alias("term"))))
    return base.select("_rec", F.explode(both).alias("t")).select(F.col("t.kind").alias("kind"), F.col("t.term").alias("term"), "_rec")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths over (kind, term, record) in sorted order; a run may span batches."""
    last = None  # kind, term, record, occurrences, records of the run not yet closed

    def row(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array([x[0]]), "term": pa.array([x[1]], pa.string()), "occurrences": pa.array([x[3]], pa.int64()), "records": pa.array([x[4]], pa.int64())})

    for b in batches:
        if not b.num_rows:
            continue
        kind, term, rec = (b.column(i) for i in range(3))
        n = b.num_rows
        differs = lambda a: np.asarray(pc.not_equal(a.slice(1), a.slice(0, n - 1)).fill_null(True)) if n > 1 else np.zeros(0, bool)
        new_term = np.concatenate(([True], differs(term) | differs(kind)))
        new_rec = new_term.copy()
        nulls = np.asarray(rec.is_null())
        if n > 1:
            new_rec[1:] |= differs(rec) & ~(nulls[1:] & nulls[:-1])
        start = np.flatnonzero(new_term)
        size = np.diff(np.append(start, n))
        records = np.add.reduceat(new_rec.astype(np.int64), start)
        first = (kind[0].as_py(), term[0].as_py(), rec[0].as_py())
        out_kind, out_term = kind.take(pa.array(start)), term.take(pa.array(start))
        size, records = size.astype(np.int64), records.astype(np.int64)
        if last is not None:
            if last[:2] == first[:2]:
                size[0] += last[3]
                records[0] += last[4] - (last[2] == first[2])
            else:
                yield row(last)
        k = len(start) - 1
        last = (out_kind[k].as_py(), out_term[k].as_py(), rec[n - 1].as_py(), int(size[k]), int(records[k]))
        if k:
            yield pa.RecordBatch.from_pydict({"kind": out_kind.slice(0, k), "term": out_term.slice(0, k), "occurrences": pa.array(size[:k]), "records": pa.array(records[:k])})
    if last is not None:
        yield row(last)


def term_frequency(df: DataFrame, column: str, record: str, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """(kind, term, occurrences, records, mark) for every distinct value (kind ``value``) and word (kind ``word``).

    ``mark`` is ``rare`` below ``rare_below`` records, ``common`` above ``common_above`` of the rows whose text is not NULL,
    else NULL; rare wins in tables so small that both hold.
    """
    pairs = term_pairs(df, column, record)
    runs = pairs.repartitionByRange("kind", "term", "_rec").sortWithinPartitions("kind", "term", "_rec").mapInArrow(_scan, "kind string, term string, occurrences long, records long")
    total = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("_total"))
    counts = runs.groupBy("kind", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("_total"), "common")
    return counts.join(F.broadcast(total)).select("kind", "term", "occurrences", "records", mark.alias("mark"))
