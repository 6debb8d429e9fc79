"""Several values packed in one field: one row per value, position kept.

The Arrow string buffer of a batch is scanned as bytes: quote parity and delimiter masks are numpy vectors, the kept bytes
are compacted, child offsets follow from the counts of cuts, and the resulting list array is flattened with the ordinals of
its parents. No Python code runs per row, but for the few lists of inverted names set off by commas alone.

Defined results: NULL, a marker of missing text, blank text and text naming nobody ("et al.", "and others", ellipses) give no
row; repeated values stay, each with its own position; a quote that is never closed is text; rows are independent of batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The markers that stand for missing text.
MISSING_MARKERS = ("NA", "couldnt find", "cant read from scrapper out")

#: Delimiters that outrank the comma, in this order; the first one present outside quotes cuts the list.
STRONG = ("|", "•", "·", "\n", "\t", ";", "/")
SUFFIX = r"(?i)^(ph\.? ?d\.?|m\.? ?d\.?|jr\.?|sr\.?|ii|iii|iv|m\.? ?sc\.?|d\.? ?sc\.?|dr\.? ?rer\.? ?nat\.?|esq\.?|frs|prof\.?|mba)$"
GROUP = r"(?i)\b(consortium|network|group|committee|initiative|collaboration|collaborative|team|society|association|institute|project|alliance|council|union|federation|laboratory|centre|center|programme|program|foundation|agency|board|panel|commission|partnership|task force)\b"
NOBODY = r"(?i)^(and |& ?)?(et\.? al\.?|others?|et alii|and others|colleagues|co-?workers|u\. ?a\.|anon(\.|ymous)?|unknown( authors?)?|n\.? ?/? ?a\.?|none|null|no authors?( listed)?|not available|\[no authors?( listed)?\]|[\p{P}\p{S}\p{Z}]*)$"
TRAILING = r"(?i)[\s,;]*\b(et\.? al\.?|and others|& others)\s*$|[\s,;]*(…|\.\.\.)\s*$"
INITIALS = r"^(\p{Lu}\p{M}?\.?[- ]?){1,4}$"
GIVEN = r"^\p{Lu}[\p{L}\p{M}'’-]+( (\p{Lu}\.?[- ]?){1,3})?$"
INVISIBLE = "​‌‍⁠﻿­"


def _bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The value bytes and int64 offsets of a string array without nulls."""
    arr = arr.cast(pa.large_string())
    _, off, val = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(arr) + 1 + arr.offset)[arr.offset :]
    data = np.frombuffer(val, dtype=np.uint8) if val is not None and val.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _from(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return c[offsets[1:]] - c[offsets[:-1]]


def _find(data: np.ndarray, needle: bytes) -> np.ndarray:
    """Mask of the positions where needle begins."""
    m = np.zeros(len(data), bool)
    n = len(data) - len(needle) + 1
    if n > 0:
        hit = data[:n] == needle[0]
        for i, c in enumerate(needle[1:], 1):
            hit &= data[i : i + n] == c
        m[:n] = hit
    return m


def _inside_quotes(data: np.ndarray, offsets: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Quote parity. Doubled quotes keep the parity; a row whose quotes don't pair off has none."""
    inside = np.zeros(len(data), bool)
    if not len(data):
        return inside
    prev = np.concatenate((np.array([32], np.uint8), data[:-1]))
    prev[offsets[:-1][offsets[:-1] < len(data)]] = 44
    nxt = np.concatenate((data[1:], np.array([44], np.uint8)))
    ends = offsets[1:][(offsets[1:] > offsets[:-1])] - 1
    nxt[ends] = 44
    edge = lambda a: np.isin(a, np.frombuffer(b" ,;[]|\t\n", np.uint8))
    solid = ~np.isin(data, np.frombuffer(b" \t\n\r[", np.uint8))
    at = np.where(solid, np.arange(len(data)), len(data))
    first = np.full(len(offsets) - 1, len(data))
    full = offsets[1:] > offsets[:-1]
    first[full] = np.minimum.reduceat(at, offsets[:-1][full])
    opens_single = np.zeros(len(first), bool)
    ok = first < offsets[1:]
    opens_single[ok] = data[first[ok]] == 39
    for quote in ((data == 34), (data == 39) & (edge(prev) | edge(nxt)) & opens_single[row]):
        even = _per_row(quote, offsets) % 2 == 0
        quote = quote & even[row]
        c = np.cumsum(quote, dtype=np.int64)
        base = np.concatenate(([0], c))[offsets[:-1]]
        inside |= ((c - base[row]) % 2 == 1) & ~quote
    return inside


def _trim(a: pa.Array) -> pa.Array:
    for _ in range(2):
        a = pc.utf8_trim(pc.utf8_trim_whitespace(a), characters=INVISIBLE)
    return a


def _is(a: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(a, pattern).to_numpy(zero_copy_only=False).astype(bool)


def split_array(texts: pa.Array) -> pa.ListArray:
    """List array of the values in each text; an empty list where there are none."""
    n = len(texts)
    null = pc.fill_null(pc.or_kleene(pc.is_null(texts), pc.is_in(texts.cast(pa.string()), pa.array(MISSING_MARKERS))), True)
    texts = _trim(pc.if_else(null, "", pc.fill_null(texts, "")).cast(pa.large_string()))
    listed = pc.match_substring_regex(texts, r"(?s)^\[\s*['\"].*['\"]\s*\]$")
    texts = pc.if_else(listed, pc.utf8_slice_codeunits(texts, 1, -1), texts)
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    data, offsets = _bytes(texts)
    row = np.repeat(np.arange(n), np.diff(offsets))
    free = ~_inside_quotes(data, offsets, row)

    # which delimiter rules each row, and the cuts it makes
    cut, width = np.zeros(len(data), bool), np.ones(len(data), np.int64)
    strong = np.zeros(n, bool)
    for d in STRONG:
        e = d.encode()
        here = _find(data, e) & free & ~strong[row]
        has = _per_row(here, offsets) > 0
        cut |= here
        width[here] = len(e)
        strong |= has
    comma = (data == 44) & free
    cut |= comma

    # compact the bytes between the cuts
    drop = cut.copy()
    for extra in (1, 2):
        at = np.flatnonzero(cut & (width > extra)) + extra
        drop[at] = True
    pos = np.flatnonzero(cut)
    starts = np.sort(np.concatenate((offsets[:-1], pos)), kind="stable")
    kept = np.concatenate(([0], np.cumsum(~drop, dtype=np.int64)))
    parent = np.concatenate((np.arange(n), row[pos]))
    by_comma = np.concatenate((np.zeros(n, bool), comma[pos]))
    order = np.lexsort((np.concatenate((np.zeros(n, np.int8), np.ones(len(pos), np.int8))), np.concatenate((offsets[:-1], pos)), parent))
    parent, by_comma = parent[order], by_comma[order]
    child = np.concatenate((kept[starts], kept[-1:]))
    atoms = _trim(_from(data[~drop], child))
    raw_start = np.concatenate((offsets[:-1], pos + width[pos]))[order]
    raw_end = np.concatenate((np.concatenate((offsets[:-1], pos))[order][1:], [len(data)]))
    raw_end = np.minimum(raw_end, offsets[1:][parent])

    # commas that belong to a value: suffixes, inverted names, groups with a comma in their name
    if by_comma.any():
        one_word = ~_is(atoms, r"[\s\p{Z}]") & (pc.binary_length(atoms).to_numpy(zero_copy_only=False) > 0) & ~_is(atoms, r"^[\"'“„«]") & ~_is(atoms, NOBODY)
        glue = np.zeros(len(parent), bool)  # True: this atom goes on with the one before
        glue[1:] = by_comma[1:]
        bare = pc.replace_substring_regex(atoms, TRAILING, "")
        suffix = _is(bare, SUFFIX)
        suffix[1:] &= (pc.binary_length(atoms).to_numpy(zero_copy_only=False) > 0)[:-1]
        group = _is(atoms, GROUP)
        initials, given = _is(bare, INITIALS), _is(bare, GIVEN)
        filled = ~_is(atoms, NOBODY)
        before = np.concatenate(([False], one_word[:-1] & ~suffix[:-1]))
        before_given = np.concatenate(([False], (one_word & ~initials)[:-1]))
        s = strong[parent]
        inverted = before & ((s & filled & ~suffix) | (before_given & (initials | given)) | group)
        # of a run of single words, every second one is the given name of the one before
        run = np.flatnonzero(inverted & glue & one_word)
        for i in run:
            if glue[i - 1] and inverted[i - 1]:
                inverted[i] = False
        glue &= suffix | inverted
        if glue.any():
            first = np.flatnonzero(~glue)
            parent, raw_start = parent[first], raw_start[first]
            raw_end = raw_end[np.concatenate((first[1:] - 1, [len(glue) - 1]))]
            size = np.maximum(raw_end - raw_start, 0)
            take = np.repeat(raw_start, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            atoms = _trim(_from(data[take], np.concatenate(([0], np.cumsum(size)))))

    # "and" between two values, unless inside the name of a group or a quoted value
    quoted = _is(atoms, r"^(\"(?s:.*)\"|'(?s:.*)')$")
    together = quoted | _is(atoms, GROUP)
    atoms = pc.if_else(pa.array(quoted), atoms, pc.replace_substring_regex(atoms, TRAILING, ""))
    atoms = pc.if_else(pa.array(together), atoms, pc.replace_substring_regex(atoms, r"(?i)^(and|&)\s+", ""))
    marked = pc.if_else(pa.array(together), atoms, pc.replace_substring_regex(atoms, r"\s+(and|&)\s+", "\x1f"))
    pieces = pc.split_pattern(marked, "\x1f")
    parent = parent[pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)]
    values = _trim(pc.list_flatten(pieces))

    # enclosing quotes
    for mark in ('"', "'"):
        inner = _is(values, f"(?s)^{mark}.*{mark}$") & (pc.utf8_length(values).to_numpy(zero_copy_only=False) >= 2)
        if mark == '"':  # a nickname alone at either end is no enclosing pair
            inner &= ~_is(values, r'(?s)^"[^"]*"[^"]+"[^"]*"$') | _is(values, r'(?s)^"([^"]|"")*"$')
        if inner.any():
            bare = pc.replace_substring(pc.utf8_slice_codeunits(values, 1, -1), mark * 2, mark)
            values = pc.if_else(pa.array(inner), bare, values)
    curly = _is(values, r"(?s)^“[^“”]*”$|^„[^„“]*“$|^«[^«»]*»$|^‘[^‘’]*’$")
    if curly.any():
        values = pc.if_else(pa.array(curly), pc.utf8_slice_codeunits(values, 1, -1), values)
    values = _trim(values)
    real = ~_is(values, NOBODY)
    values, parent = values.filter(pa.array(real)), parent[real]
    counts = np.bincount(parent, minlength=n) if len(parent) else np.zeros(n, np.int64)
    child_offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(child_offsets), values.cast(pa.string()))


def flatten_batch(batch: pa.RecordBatch, column: str, keep: list[str], item: str, pos: str) -> pa.RecordBatch:
    lists = split_array(batch.column(batch.schema.get_field_index(column)))
    parents = pc.list_parent_indices(lists)
    number = np.arange(len(parents), dtype=np.int64) - lists.offsets.to_numpy()[parents.to_numpy()] + 1
    cols = {c: batch.column(batch.schema.get_field_index(c)).take(parents) for c in keep}
    return pa.RecordBatch.from_pydict(cols | {pos: pa.array(number.astype(np.int32)), item: pc.list_flatten(lists)})


def split_values(df: DataFrame, column: str, keep: list[str], item: str = "item", pos: str = "item_no") -> DataFrame:
    """One row per value of ``column``, with the columns ``keep``, its 1-based place ``pos`` and the value ``item``.

    Narrow: no shuffle, work in proportion to the bytes of the column. Only the named columns are read. A kept column named
    like ``item`` or ``pos`` is refused.
    """
    if clash := {item, pos} & set(keep):
        raise ValueError(f"column names clash: {sorted(clash)}")
    inner = [f"_k{i}" for i in range(len(keep))]
    src = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(keep, inner)], F.col(f"`{column}`").alias("_v"))
    src = src.where(F.col("_v").isNotNull() & ~F.col("_v").isin(*MISSING_MARKERS))
    schema = T.StructType([*[T.StructField(a, src.schema[a].dataType) for a in inner], T.StructField("_p", T.IntegerType()), T.StructField("_i", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield flatten_batch(b, "_v", inner, "_i", "_p")

    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(a).alias(c) for c, a in zip(keep, inner)], F.col("_p").alias(pos), F.col("_i").alias(item))
