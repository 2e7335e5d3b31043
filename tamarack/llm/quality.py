"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labelled import fitted, held_out

#: Labelled rows that are learnt from, of quality 0 and 1, at most; with DIMENSIONS this bounds what is broadcast.
MOST = (2000, 4000)
#: Buckets of byte trigrams, latent dimensions, neighbours that vote, power of the similarity in a vote.
BUCKETS, DIMENSIONS, NEIGHBOURS, POWER = 4096, 32, 30, 20
#: Documents in a block of cosine products.
BLOCK = 512


def counts(text: str) -> np.ndarray:
    """Logarithms of trigram counts by bucket."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.float32)
    h = ((b[:-2] << np.uint32(16)) + (b[1:-1] << np.uint32(8)) + b[2:]) * np.uint32(2654435761) >> np.uint32(20)
    return np.log1p(np.bincount(h, minlength=BUCKETS)).astype(np.float32)


def shares(text: str) -> np.ndarray:
    """Roots of the shares of words that repeat the one before, of capitals, signs and digits: terms beside the trigrams."""
    b = text.encode()
    words, a = b.split(), np.frombuffer(b, np.uint8)
    again = sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(1, len(words))
    kinds = np.bincount(_KIND[a], minlength=4)[1:] / max(1, len(a))
    return np.sqrt(np.array([again, *kinds], np.float32))


_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(123, 127)]] = 2
_KIND[48:58] = 3


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def terms(self, texts: list[str]) -> np.ndarray:
        return _unit(np.c_[_unit(np.array([counts(t) for t in texts]) * self.idf), np.array([shares(t) for t in texts])])

    def scores(self, texts: list[str]) -> np.ndarray:
        """Exact cosines with all labelled vectors; the nearest vote by similarity and their class's weight."""
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        cosine = _unit(self.terms(texts) @ self.basis) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER * self.weights[near]
        total = vote.sum(1)
        return np.where(total > 0, (vote * self.labels[near]).sum(1) / np.maximum(total, 1e-300), self.prior).clip(0, 1)


def fit(texts: list[str], labels: list[int], numbers: tuple[int, int]) -> Model:
    """Latent-semantic basis (randomised SVD of weighted terms) and the labelled rows' vectors in it."""
    prior = (numbers[1] + 1) / (sum(numbers) + 2)
    model = Model(np.ones(BUCKETS, np.float32), np.zeros((BUCKETS + 4, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior)
    if not texts:
        return model
    raw = np.array([counts(t) for t in texts])
    model.idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 0.1).astype(np.float32)
    x = model.terms(texts).astype(np.float32)
    y = x @ np.random.default_rng(0).standard_normal((x.shape[1], DIMENSIONS + 16)).astype(np.float32)
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    model.basis = np.ascontiguousarray(np.linalg.svd(q.T @ x, full_matrices=False)[2][:DIMENSIONS].T)
    model.vectors, model.labels = _unit(x @ model.basis), np.array(labels)
    own = np.bincount(model.labels, minlength=2)
    model.weights = (np.array(numbers) / np.maximum(own, 1))[model.labels]
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs``, all columns, with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Learns from up to MOST labelled rows of each class of ``labels`` (columns
    ``<id>, quality``) that aren't held out. Every text's vector, from the
    whole text alone, is compared with all labelled vectors in blocks; the
    NEIGHBOURS nearest vote.

    Null and empty texts, and texts like no labelled one, get the share of
    class 1; null ids aren't held out. Without labels all scores are 0.5. Rows
    stay as they come; columns named like the three new ones are replaced. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fitted(docs, labels, "quality", MOST, fit, id_col, text_col))
    rows = docs.drop("held_out", "score", "predicted")
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                score = model.value.scores([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "score"])

    scored = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.select(*[F.col(f"`{c}`") for c in rows.columns], held_out(F.col(f"`{id_col}`")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
