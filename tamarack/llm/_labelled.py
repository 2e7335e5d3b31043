"""A bounded, repeatable sample of labelled documents, and a model fitted on it in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int], fit: Callable, id_col: str = "doc_id", text_col: str = "text"):
    """``fit(texts, labels, counts)`` on up to ``most[c]`` rows of each class c, first by hash of their id.

    Held-out ids, null ids and labels other than 0 and 1 are left aside. The
    sample is cut from the labels alone, so what is broadcast to find its texts
    has at most sum(most) rows. ``counts`` are all usable labels by class. The
    fit runs on an executor; the driver gets the model only.
    """
    usable = labels.select(F.col(id_col).alias("of"), F.col(label).cast("int").alias("y")).where(F.col("of").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("of"))).distinct()
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [usable.where(F.col("y") == c).orderBy(F.xxhash64("of"), "of").limit(most[c]) for c in (0, 1)]
    chosen = F.broadcast(first[0].unionAll(first[1]))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = texts.join(chosen, F.col("id") == F.col("of")).select(F.xxhash64("of").alias("h"), "of", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], str(r[1]), r[2] or "", r[3]))
        model = fit([r[2] or "" for r in got], [r[3] for r in got], (counts.get(0, 0), counts.get(1, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    out = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(out[0]["model"]) if out else fit([], [], (counts.get(0, 0), counts.get(1, 0)))
