"""Vectors for texts: an embedder is any function from a list of texts to a matrix."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dims: int = 64) -> Embedder:
    """Words hashed into signed dimensions, of length 1: the same everywhere, without a model."""

    def embed(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in re.findall("[A-Za-z0-9]+", t):
                h = xxhash.xxh64_intdigest(w.lower())
                out[i, h % dims] += 1.0 if h >> 63 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1.0)

    return embed


def with_embeddings(docs: DataFrame, make: Callable[[], Embedder], *, text: str = "text", output: str = "embedding", batch: int = 16) -> DataFrame:
    """``docs`` with ``output``; ``make`` runs once a task, so that a model loads once, and texts go in batches."""
    kept = docs.drop(output)
    schema = StructType([*kept.schema.fields, StructField(output, ArrayType(FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for p in parts:
            texts = p[text].fillna("").tolist()
            rows = [v for at in range(0, len(texts), batch) for v in np.asarray(embed(texts[at : at + batch]), np.float32)]
            yield p.assign(**{output: rows})

    return kept.mapInPandas(run, schema)


def unit_length(docs: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors over their norm; a zero vector stays."""
    from ..functions.exprs import norm

    n = norm(F.col(column))
    return docs.withColumn(column, F.transform(column, lambda x: F.when(n > 0, x / n).otherwise(x)))
