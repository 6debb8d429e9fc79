"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter and is read where the work is done."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a file of ranks; loaded once a worker process."""
    if path not in _loaded:
        import tiktoken

        try:
            from public_tokenizers import PATTERN as pattern
        except ImportError:
            pattern = PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and the number of ``tokens`` of each text; NULL and empty texts have none and are left out."""
    inner = [f"_k{i}" for i in range(len(keep))]
    src = df.select(*[F.col(c).alias(a) for c, a in zip(keep, inner)], F.col(text).alias("_t")).where(F.col("_t").isNotNull() & (F.col("_t") != ""))
    schema = T.StructType([*[T.StructField(a, src.schema[a].dataType) for a in inner], T.StructField("_n", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            enc = encoder(vocabulary)
            b["_n"] = pd.Series([len(enc.encode_ordinary(t)) for t in b["_t"]], dtype="int32", index=b.index)
            yield b.drop(columns="_t")

    return spread(src).mapInPandas(run, schema).select(*[F.col(a).alias(c) for c, a in zip(keep, inner)], F.col("_n").alias("tokens"))
