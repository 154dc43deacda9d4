"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.runtime import materialize

#: A byte-level BPE vocabulary as lines of base64 token and rank; any such file on every executor will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """`keep` and `n_tokens` of each document, written once; whole texts, a null or empty text has 0.

    Rows delivered again count once. Strings of special tokens are ordinary text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(len(keep))]
            columns = [*batch.columns[: len(keep)], pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens"])

    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_tokens long"
    return materialize(documents.select(*keep, F.col("text")).mapInArrow(count, schema).distinct())
