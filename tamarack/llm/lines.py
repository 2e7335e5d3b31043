"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import shared_dir, stash

_WS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased (bytes.lower leaves all but ASCII)."""
    return line.strip(_WS).lower()


def _hashes(lines: list[bytes]) -> list[bytes]:
    """128-bit hashes of the lines' keys; an empty key, which never counts, gives b''."""
    return [xxhash.xxh3_128_digest(k) if (k := line_key(x)) else b"" for x in lines]


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """``id, h``: each distinct key of each document, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, text in enumerate(_texts(batch.column(1))):
                lines = text.split(b"\n")
                if min_chars > 1:
                    lines = [x for x in lines if len(line_key(x).decode()) >= min_chars]
                got = set(_hashes(lines)) - {b""}
                found += got
                ids += [i] * len(got)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.binary())], ["id", "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, h binary")


class LineRuns:
    """Counts of line hashes, as sorted runs on levels.

    ``add`` counts the documents of a batch that hold each hash, merge-anti-joins
    the hashes that some run already has ``enough`` times (they are decided) and
    writes the rest as a sorted run of level 0. ``fanout`` runs of a level are
    merged into one of the next, so every hash is rewritten a logarithmic number
    of times. Runs are Parquet in the shared folder, hash-partitioned and sorted.
    """

    def __init__(self, spark: SparkSession, enough: int, fanout: int = 2, path: str | None = None):
        self.spark, self.enough, self.fanout = spark, enough, fanout
        self.path, self.made, self.levels = path or shared_dir(spark), 0, [[]]

    def _write(self, counts: DataFrame, level: int) -> None:
        run = counts.repartition("h").sortWithinPartitions("h")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stash(run, f"{self.path}/run{self.made}"))
        self.made += 1

    def _all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, hashes: DataFrame) -> None:
        counts = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        for run in self._all():
            counts = counts.join(run.where(F.col("n") >= self.enough).select("h").hint("merge"), "h", "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._write(reduce(DataFrame.unionAll, runs).groupBy("h").agg(F.sum("n").alias("n")), level + 1)
            level += 1

    def frequent(self) -> DataFrame:
        """``h`` of all keys that ``enough`` documents hold."""
        if not self._all():
            return self.spark.createDataFrame([], "h binary")
        return reduce(DataFrame.unionAll, self._all()).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= self.enough).select("h")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 3) -> DataFrame:
    """One row per input row: ``<id>, n_lines, n_dropped, kept_text``.

    Keys of ``min_chars`` code points or more that ``min_docs`` rows hold lose
    all their lines. The documents arrive in ``batches`` parts, as they would
    over time, each of which ``LineRuns`` takes in turn; the decision then holds
    for all. Null or empty texts are one empty line. Rows with the same id or
    none are counted one by one. Long texts are held one at a time.
    """
    spark, top = docs.sparkSession, shared_dir(docs.sparkSession)
    lines = stash(line_hashes(docs, id_col, text_col, min_chars), f"{top}/lines")
    runs = LineRuns(spark, min_docs, path=f"{top}/runs")
    for k in range(batches):
        runs.add(lines.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k))
    dropped = stash(runs.frequent(), f"{top}/frequent")
    per_doc = lines.join(dropped, "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias("gone"))
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    joined = d.join(per_doc.hint("shuffle_hash"), d["doc"].eqNullSafe(per_doc["id"]), "left").select("doc", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cut, kept = [], [], []
            for text, gone in zip(_texts(batch.column(1)), batch.column(2), strict=True):
                lines = text.split(b"\n")
                n.append(len(lines))
                if gone.is_valid:
                    bad = set(gone.as_py())
                    rest = [x for x, h in zip(lines, _hashes(lines), strict=True) if h not in bad]
                else:
                    rest = lines
                cut.append(len(lines) - len(rest))
                kept.append(b"\n".join(rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array([x.decode() for x in kept], pa.string())], [id_col, "n_lines", "n_dropped", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_lines long, n_dropped long, kept_text string")
