"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that part text before the merges of the public rank files.
PATTERN_50K = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PATTERN_100K = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""

#: Ranks used where no other file is named. cl100k_base has the same format: name its file where there is one.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str):
    """A byte-level BPE from a file of ranks; a vocabulary above 60,000 has the 100k pattern."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN_100K if len(ranks) > 60_000 else PATTERN_50K, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, keys: list[Column], text: Column, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``keys`` and ``tokens``: the size of each text, 0 for null; strings of special tokens are ordinary text."""
    source = df.select(*keys, text.alias("_text"))
    schema = source.select(source.columns[:-1]).schema.add("tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks).encode_ordinary
        for b in batches:
            sizes = [0 if not t else len(encode(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*b.schema.names[:-1], "tokens"])

    return source.mapInArrow(count, schema)
