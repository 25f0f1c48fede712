"""Models are passed in: an object with the method named here, created once in each task and called in batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class HashedWords:
    """Bag of words hashed into a unit vector; needs no files, for tests and as a fallback."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for w in (text or "").lower().split():
                row[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim] += 1
        return (out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))).tolist()


def embedded(df: DataFrame, text: str, make: Callable, *, batch: int = 32, column: str = "vector") -> DataFrame:
    """df with the vectors that make().embed(texts) gives; the batch size changes nothing but speed."""
    if batch < 1:
        raise ValueError("batch must be positive")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in batches:
            texts = [t or "" for t in rows.column(at).to_pylist()]
            vectors = [v for k in range(0, len(texts), batch) for v in model.embed(texts[k : k + batch])]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*rows.schema.names, column])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{column}` array<double>")


def reranked(candidates: DataFrame, make: Callable, n: int) -> DataFrame:
    """The n best of each query by make().score(query_texts, texts); candidates: query, chunk_id, query_text, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in batches:
            query, chunk, asked, text = (c.to_pylist() for c in rows.columns)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.string()), pa.array(chunk, pa.string()), pa.array([float(x) for x in model.score(asked, text)], pa.float64())], names=["query", "chunk_id", "score"])

    scored = candidates.select("query", "chunk_id", "query_text", "text").mapInArrow(run, "query string, chunk_id string, score double")
    by = Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)
