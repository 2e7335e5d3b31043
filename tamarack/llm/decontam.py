"""Benchmark decontamination: size-partitioned MinHash containment search, verified on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._text import Words, grams, sets, slices, words
from ._work import shared_dir, stash

#: Shingles of the benchmark items that one pass over the documents searches for.
BLOCK = 1 << 19


@dataclass
class Items:
    """Benchmark items with their sketches, by classes of size.

    The sketch of an item of q shingles holds its q - need + 1 smallest hashes,
    a bottom-k MinHash. A set that holds ``need`` of the q shingles can miss at
    most q - need, so it holds at least one of the sketch. Classes double in
    size; one whose smallest item needs more shingles than a document has is
    not searched.
    """

    percent: int
    size: int
    ids: list = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    shingles: list[set[bytes]] = field(default_factory=list)
    need: list[int] = field(default_factory=list)

    def add(self, item, column: pa.Array) -> None:
        w = words(column, lower=True)
        (members,) = sets(w, self.size)
        if not len(members):
            return
        n = len(w.hash)
        all_words = [w.word(i) for i in range(n)]
        self.ids.append(item)
        self.hashes.append(members)
        self.shingles.append({b" ".join(all_words[i : i + self.size]) for i in range(max(1, n - self.size + 1))})
        self.need.append(-(-self.percent * len(members) // 100))

    def close(self) -> Items:
        parts: dict[int, list[int]] = {}
        for i, h in enumerate(self.hashes):
            parts.setdefault(len(h).bit_length(), []).append(i)
        self.classes = []
        for _, own in sorted(parts.items()):
            sketch = [np.sort(self.hashes[i])[: len(self.hashes[i]) - self.need[i] + 1] for i in own]
            value, owner = np.concatenate(sketch), np.repeat(own, [len(s) for s in sketch])
            order = np.argsort(value, kind="stable")
            self.classes.append((min(self.need[i] for i in own), value[order], owner[order]))
        return self

    def hits(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """Text, item, and number of the item's shingles in the text, where there are enough."""
        h, first = grams(w, self.size)
        count = np.diff(first)
        found: set[tuple[int, int]] = set()
        for least, value, owner in self.classes:
            lo = np.searchsorted(value, h)
            near = np.flatnonzero(value[np.minimum(lo, len(value) - 1)] == h)
            text = np.searchsorted(first, near, "right") - 1
            enough = count[text] >= least
            for t, k in zip(text[enough].tolist(), near[enough].tolist(), strict=True):
                at = int(lo[k])
                while at < len(value) and value[at] == h[k]:
                    found.add((t, int(owner[at])))
                    at += 1
        for t, i in sorted(found):
            own = h[first[t] : first[t + 1]]
            places = np.flatnonzero(np.isin(own, self.hashes[i]))
            if len(places) >= self.need[i]:
                s, n = int(w.first[t]), int(w.first[t + 1] - w.first[t])
                runs = {b" ".join([w.word(s + p + j) for j in range(min(self.size, n))]) for p in places.tolist()}
                if (shared := len(runs & self.shingles[i])) >= self.need[i]:
                    yield t, i, shared


def blocks(benchmark: DataFrame, item_col: str, text_col: str, percent: int, size: int, block: int) -> Iterator[Items]:
    """The items in parts whose shingles have a bound; each part is what the driver holds and sends out at one time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (4 * block)))  # a shingle begins at a word, hence at every second character or fewer
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        out = Items(percent, size)
        for row in part.toLocalIterator():
            out.add(row["item"], pa.array([row["text"]], pa.string()))
        if out.ids:
            yield out.close()


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", percent: int = 80, size: int = 5, block: int = BLOCK) -> DataFrame:
    """``<id>, <item>, n_shared, n_item``: documents that hold ``percent`` of an item's distinct shingles or more.

    Words are maximal runs without white space, A-Z lower-cased. A text of
    fewer than ``size`` words has one shingle, the whole of it, so that such an
    item is found in documents of just those words. The benchmark is searched
    in blocks of bounded size, one pass over the documents each, without a
    shuffle and one block at a time; sketches find candidates (none is missed), words decide.

    Null and empty texts and items hold and match nothing. Repeated documents
    and items are found one by one, null ids are kept. An empty table on
    either side gives an empty result; further columns are not looked at.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, n_shared long, n_item long"
    found, top = [], shared_dir(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    for items in blocks(benchmark, item_col, item_text, percent, size, block):
        if found:  # written before the next block is sent out, so that no machine holds more than one
            found[-1] = stash(found[-1], f"{top}/block{len(found)}")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for lo, hi in slices(batch.column(1)):
                    hits = list(items.hits(words(batch.column(1).slice(lo, hi - lo), lower=True)))
                    t, i, n = zip(*hits, strict=True) if hits else ((), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo).take(pa.array(t, pa.int64())), pa.array([items.ids[x] for x in i], item_type), pa.array(n, pa.int64()), pa.array([len(items.hashes[x]) for x in i], pa.int64())],
                        [id_col, item_col, "n_shared", "n_item"],
                    )

        found.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", percent: int = 80, size: int = 5, block: int = BLOCK) -> DataFrame:
    """``docs``, all columns, without the rows that ``find_items`` finds.

    Each block of items is one pass; what it leaves is written for the next, so
    that no machine holds more than one block. Rows of null id or text stay.
    """
    spark, at, top = docs.sparkSession, docs.columns.index(text_col), shared_dir(docs.sparkSession)
    for k, items in enumerate(blocks(benchmark, item_col, item_text, percent, size, block)):
        if k:
            docs = stash(docs, f"{top}/left{k}")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(at)
                for lo, hi in slices(text):
                    bad = {t for t, _, _ in shared.value.hits(words(text.slice(lo, hi - lo), lower=True))}
                    yield batch.slice(lo, hi - lo).filter(pa.array([t not in bad for t in range(hi - lo)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

