"""Vectors of texts by any embedder: a function from a list of texts to a matrix, run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.runtime import spread

Embedder = Callable[[list[str]], np.ndarray]
DIMENSIONS = 256


def hashed_words(texts: list[str]) -> np.ndarray:
    """The default embedder: words and pairs of words hashed to signed dimensions. No model and no downloads; a sentence
    model is passed in where there is one."""
    out = np.zeros((len(texts), DIMENSIONS))
    for k, t in enumerate(texts):
        ws = re.findall(r"\w+", t.lower())
        for x in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]:
            h = xxhash.xxh3_64_intdigest(x)
            out[k, h % DIMENSIONS] += 1.0 if h >> 63 else -1.0
    return out


def embed(df: DataFrame, key: str, text: str, embedder: Embedder = hashed_words, batch: int = 64) -> DataFrame:
    """(key, embedding): vectors of length one, `batch` texts to a call. Null texts count as empty; a text without a
    word has the zero vector, which is similar to nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["t"].fillna("").tolist()
            made = [np.asarray(embedder(texts[a : a + batch]), dtype=np.float64) for a in range(0, len(texts), batch)]
            if made:
                m = np.concatenate(made)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                yield pd.DataFrame({key: b[key], "embedding": list(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))})

    picked = df.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias("t")).filter(F.col(key).isNotNull())
    return spread(picked, key).mapInPandas(run, f"`{key}` long, embedding array<double>")
