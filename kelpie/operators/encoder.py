"""An encoder learned from the corpus: the leading singular vectors of its hashed term counts.

A text is a vector of DIM hashed terms, each 1 + ln of its count, of length 1. The range of the counts' Gram matrix is
found by a random sketch that is multiplied by it in a few passes (Halko, Martinsson and Tropp, 2011). A task adds up a
matrix of a fixed size over its texts; those are added in a tree, so the driver gets a few of them whatever the corpus.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions import text as T
from kelpie.shared import find_package, spread

#: Hashed terms; columns of the sketch beyond those that are asked for.
DIM, EXTRA = 4096, 16


def weights(tokens: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hashed term and weight of each term of texts, given as lists of tokens; each text has length 1."""
    found = tokens.flatten().dictionary_encode()
    buckets = np.array([zlib.crc32(w.encode()) % dim for w in found.dictionary.to_pylist()], np.int64)
    n = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    cell, count = np.unique(np.repeat(np.arange(len(n)), n) * dim + (buckets[found.indices.to_numpy()] if len(buckets) else np.zeros(0, np.int64)), return_counts=True)
    text, w = cell // dim, 1 + np.log(count)
    return text, cell % dim, w / np.sqrt(np.bincount(text, w * w, len(n)))[text]


def times(text: np.ndarray, term: np.ndarray, w: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """The texts' vectors times a matrix, a slice of texts at a time."""
    out = np.zeros((n, m.shape[1]))
    for a in range(0, len(text), 1 << 16):
        np.add.at(out, text[a : a + (1 << 16)], w[a : a + (1 << 16), None] * m[term[a : a + (1 << 16)]])
    return out


def _summed(words: DataFrame, sent, dim: int, gram: bool) -> np.ndarray:
    """X'XM, or (XM)'(XM), over all texts X."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        total = np.zeros((m.shape[1] if gram else dim, m.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.column(0).slice(at, 1024)
                text, term, w = weights(some, dim)
                y = times(text, term, w, m, len(some))
                if gram:
                    total += y.T @ y
                else:
                    np.add.at(total, term, w[:, None] * y[text])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["m"])

    rows = words.mapInArrow(run, "m binary").rdd.map(lambda r: pickle.loads(r[0]))
    return rows.treeReduce(np.add, max(2, rows.getNumPartitions().bit_length() // 3 + 1))


@dataclass
class Encoder:
    """values: the leading singular values of the texts' vectors, vectors: their right singular vectors, as columns."""

    values: np.ndarray
    vectors: np.ndarray

    def udf(self, tokenizer: Callable[[Column], Column] = T.tokens) -> Callable[[Column | str], Column]:
        """A text column to unit vectors; texts without a known term have a zero vector."""
        vectors = self.vectors

        @F.pandas_udf("array<float>")
        def encode(tokens: pd.Series) -> pd.Series:
            own = pa.array([[] if t is None else list(t) for t in tokens], pa.list_(pa.string()))
            y = times(*weights(own, len(vectors)), vectors, len(own))
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            return pd.Series(list(y.astype(np.float32)))

        return lambda c: encode(tokenizer(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))


def fit(corpus: DataFrame, k: int = 64, dim: int = DIM, passes: int = 2, tokenizer: Callable[[Column], Column] = T.tokens, seed: int = 0) -> Encoder:
    """The encoder to k numbers of a corpus (text); passes: how often the sketch is multiplied by the Gram matrix."""
    spark = corpus.sparkSession
    find_package(spark)
    words = spread(corpus).select(tokenizer(F.coalesce("text", F.lit(""))).alias("w"))
    q = np.random.default_rng(seed).normal(size=(dim, min(k + EXTRA, dim)))
    for _ in range(passes):
        q = np.linalg.qr(_summed(words, spark.sparkContext.broadcast(q), dim, False))[0]
    values, u = np.linalg.eigh(_summed(words, spark.sparkContext.broadcast(q), dim, True))
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    return Encoder(np.sqrt(np.maximum(values, 0)), q @ u)
