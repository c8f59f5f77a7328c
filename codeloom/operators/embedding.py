"""Embedding of units by a pluggable provider, only where no vector can be reused."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import dense_document

SCHEMA = "qualified_name string, model_id string, fingerprint string, vector array<float>"


class EmbeddingProvider(Protocol):
    """Raw vectors of texts; they are normalised by the search, not here."""

    model_id: str
    dimension: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashedWords:
    """An offline provider: words hashed to signed buckets.  The same text always gives the same vector."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self.model_id = f"hashed-words-{dimension}"

    def embed_query(self, text: str) -> np.ndarray:
        out = np.zeros(self.dimension, dtype=np.float32)
        for word in re.findall(r"[^\W_]+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[h % self.dimension] += 1 if h >> 63 else -1
        if not out.any():
            out[0] = 1
        return out

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.embed_query(t) for t in texts]) if texts else np.empty((0, self.dimension), np.float32)


def embed_units(units: DataFrame, provider: EmbeddingProvider, held: DataFrame | None = None) -> DataFrame:
    """(qualified_name, model_id, fingerprint, vector) of all units.

    A vector of ``held`` (same columns) is reused if name, text and model are the
    same; only the rest is embedded, in Arrow batches.
    """
    text = dense_document(F.col("qualified_name"), F.col("signature"), F.col("source_text"))
    docs = units.select("qualified_name", text.alias("text"), F.sha2(text, 256).alias("fingerprint"))
    model, dimension = provider.model_id, provider.dimension

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = np.asarray(provider.embed_documents(pdf["text"].tolist()), dtype=np.float32)
            if vectors.shape != (len(pdf), dimension) or not np.isfinite(vectors).all() or not vectors.any(axis=1).all():
                raise ValueError("a provider must return one finite vector that is not zero per text")
            yield pd.DataFrame({"qualified_name": pdf["qualified_name"], "model_id": model, "fingerprint": pdf["fingerprint"], "vector": list(vectors)})

    if held is None:
        return docs.mapInPandas(embed, SCHEMA)
    same = held.where((F.col("model_id") == model) & (F.size("vector") == dimension)).select("qualified_name", "fingerprint", "model_id", "vector").dropDuplicates(["qualified_name", "fingerprint"])
    kept = same.join(docs.select("qualified_name", "fingerprint"), ["qualified_name", "fingerprint"], "left_semi")
    fresh = docs.join(same.select("qualified_name", "fingerprint"), ["qualified_name", "fingerprint"], "left_anti").mapInPandas(embed, SCHEMA)
    return kept.select("qualified_name", "model_id", "fingerprint", "vector").unionByName(fresh)
