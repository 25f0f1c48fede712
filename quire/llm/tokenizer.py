"""Token counts of public tokenizers; their files are read, never copied or trained."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()]
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=[*(n for n in batch.schema.names if n != batch.schema.names[at]), "tokens"])

    return run


def token_counts(df: DataFrame, ident: str, text: str, extra: dict | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """ident, the extra columns (name -> Column) and tokens bigint of every row; null and empty texts have 0 tokens."""
    extra = extra or {}
    rows = df.select(F.col(f"`{ident}`").alias("ident"), *(c.alias(n) for n, c in extra.items()), F.col(f"`{text}`").cast("string").alias("text"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in rows.columns if n != "text") + ", tokens bigint"
    return rows.mapInArrow(_count(vocabulary, len(rows.columns) - 1), schema)


__all__ = ["DEFAULT_VOCABULARY", "encoder", "token_counts"]
