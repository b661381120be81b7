"""Embedding models as an interface, and a deterministic one that needs no model file."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from passagework.functions import text as T


class Embedder(Protocol):
    """A model: made once per task, asked in batches.  Instances must be picklable and cheap until used."""

    model_name: str
    dimension: int
    max_sequence_length: int

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def count_tokens(self, text: Column) -> Column: ...


class HashingEmbedder:
    """Feature hashing of folded words and word pairs with signs; equal texts have equal unit vectors.

    ``tokens`` counts tokens (``functions.subwords.counter``); without it words and two specials are counted."""

    def __init__(self, dimension: int = 384, max_sequence_length: int = 512, model_name: str = "hashing", tokens: Callable[[Column], Column] | None = None):
        self.dimension, self.max_sequence_length, self.model_name, self.tokens = dimension, max_sequence_length, model_name, tokens

    def __getstate__(self) -> dict:
        return {**self.__dict__, "tokens": None}  # tasks embed; counting is planned on the driver

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            words = text.casefold().split()
            features = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]
            h = np.frombuffer(b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features), "<u8")
            weight = np.where(np.arange(len(h)) < len(words), 1.0, 0.5)
            # Sums of halves are exact, in whatever order.
            row += np.bincount((h % np.uint64(self.dimension)).astype(np.int64), np.where(h >> np.uint64(63), weight, -weight), self.dimension)
        return out

    def count_tokens(self, text: Column) -> Column:
        return self.tokens(text) if self.tokens else T.word_count(text) + 2


def embedded(rows: DataFrame, embedder: Embedder, text: str, batch: int = 32) -> DataFrame:
    """``rows`` with column embedding (array<double>, as the model gives it) of a text column."""

    @pandas_udf("array<double>")
    def model(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            values = [v for i in range(0, len(texts), batch) for v in embedder.embed(texts.iloc[i : i + batch].fillna("").tolist())]
            yield pd.Series(values)

    return rows.withColumn("embedding", model(F.col(text)))
