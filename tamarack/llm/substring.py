"""Removal of repeated passages with compressed full-text indexes, one for each shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._fm import FMIndex
from ._skew import join_groups
from ._text import PIECE, Words, grams, words
from ._work import shared_dir, stash

#: Words of an anchor run; with windows of 20 words, 16 runs compete.
_ANCHOR = 5
#: Words of a shard, beyond which it is closed, and pieces of one anchor beyond which its windows are dealt out anew.
_SHARD, _CROWD = 1 << 20, 1 << 14


def pieces(w: Words, window: int, digests: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Runs of windows that share their anchor: text, first window, number of windows, anchor hash and 128-bit digest of the words.

    A window's anchor is the leftmost smallest hash of its runs of _ANCHOR
    words, so that equal windows have equal anchors at the same distance. A
    piece's windows have one anchor at one place; no two of them are equal.
    """
    h, first = grams(w, _ANCHOR, short=False)
    span = window - _ANCHOR + 1
    count = np.maximum(np.diff(w.first) - window + 1, 0)
    value, place, width = h, np.arange(len(h)), 1
    while width < span:
        step = min(width, span - width)
        n = max(len(value) - step, 0)
        less = value[step:] < value[:n]
        value, place = np.where(less, value[step:], value[:n]), np.where(less, place[step:], place[:n])
        width += step
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    run = first[:-1][doc] + at
    place = place[run]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([new, [len(doc)]]))
    doc, at, anchor = doc[new], at[new], h[place[new]]
    if not digests:
        return doc, at, n, anchor.view(np.int64), []
    s = w.first[:-1][doc] + at
    text, begin = w.spaced()
    view = memoryview(text)
    content = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(begin[s].tolist(), begin[s + n + window - 1].tolist(), strict=True)]
    return doc, at, n, anchor.view(np.int64), content


def _emit(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, texts in _unpacked(batch.column(2)):
                doc, at, n, anchor, content = pieces(words(texts), window)
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(content, pa.binary())],
                    ["id", "rid", "at", "n", "anchor", "content"],
                )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames, for the way through a shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        text = [press.compress(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary())], ["id", "z"])


def _unpacked(column: pa.Array, most: int = 2 * PIECE) -> Iterator[tuple[int, int, pa.Array]]:
    """Rows lo to hi with their texts, a bounded number of bytes at a time."""
    press, lo, size, texts = zstandard.ZstdDecompressor(), 0, 0, []
    for i, z in enumerate(column):
        texts.append(press.decompress(z.as_py()) if z.is_valid else b"")
        size += len(texts[-1])
        if size >= most:
            yield lo, i + 1, pa.array(texts, pa.large_binary())
            lo, size, texts = i + 1, 0, []
    if texts:
        yield lo, len(column), pa.array(texts, pa.large_binary())


def _fetch(window: int):
    """The texts of the pieces that a document was asked for; of crowded anchors one row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _unpacked(batch.column(2)):
                w = words(texts)
                doc, at, n, anchor, _ = pieces(w, window, digests=False)
                ask = batch.column(3).slice(lo, hi - lo)
                flat, owner = ask.flatten(), np.repeat(np.arange(hi - lo), np.diff(ask.offsets.to_numpy()))
                where = {(d, a): i for i, (d, a) in enumerate(zip(doc.tolist(), at.tolist(), strict=True))}
                rows: list[tuple] = []
                for d, a, split in zip(owner.tolist(), flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True):
                    i = where[d, a]
                    s, m = int(w.first[d]) + a, int(n[i])
                    one = [w.word(k) for k in range(s, s + m + window - 1)]
                    if split <= 1:
                        rows.append((int(anchor[i]), 0, d + lo, a, 0, b" ".join(one)))
                    else:
                        for j in range(m):
                            part = b" ".join(one[j : j + window])
                            rows.append((int(anchor[i]), int.from_bytes(hashlib.blake2b(part, digest_size=7).digest()) % split, d + lo, a, j, part))
                c = list(zip(*rows, strict=True)) if rows else [()] * 6
                take = pa.array(c[2], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.binary())],
                    ["anchor", "sub", "id", "rid", "at", "skip", "words"],
                )

    return run


def _search(window: int):
    """Shards of whole (anchor, sub) groups: index them, search all their windows, report those that begin earlier too."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] + r[3]))  # by first place
        ids: dict[bytes, int] = {}
        text: list[int] = []
        begin, count = [], []
        for r in rows:
            begin.append(len(text))
            text += [ids.setdefault(x, len(ids) + 1) for x in r[4].split(b" ")]
            count.append(len(text) - begin[-1] - window + 1)
            text.append(0)
        seq, begin, count = np.array(text, np.int64), np.array(begin), np.array(count)
        owner = np.repeat(np.arange(len(rows)), count)
        inner = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        starts = begin[owner] + inner
        first = FMIndex(seq).repeats(starts, seq, window)
        hit = np.flatnonzero(first != starts)
        mask = np.zeros(len(rows), np.int64)
        np.bitwise_or.at(mask, owner[hit], np.int64(1) << (inner[hit] + np.array([r[3] for r in rows])[owner[hit]]))
        out = [(*rows[i][1:3], int(mask[i])) for i in np.flatnonzero(mask)]
        c = list(zip(*out, strict=True)) if out else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64())], ["rid", "at", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, group = [], 0, None
        for batch in batches:
            for anchor, sub, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= _SHARD and group != (anchor, sub):
                    yield shard(rows)
                    rows, size = [], 0
                group = anchor, sub
                rows.append(tuple(row))
                size += row[4].count(b" ") + 2
        if rows:
            yield shard(rows)

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _unpacked(batch.column(1)):
                total, gone, kept = [], [], []
                w = words(texts)
                doc, at, n, _, _ = pieces(w, window, digests=False)
                known = {(d, a): i for i, (d, a) in enumerate(zip(doc.tolist(), at.tolist(), strict=True))}
                for d in range(hi - lo):
                    marks, m = batch.column(2)[lo + d], int(w.first[d + 1] - w.first[d])
                    own = texts[d].as_py().split()
                    total.append(m)
                    cover = np.zeros(m + 1, np.int64)
                    for x in marks.as_py() or ():
                        for j in range(int(n[known[d, x["at"]]])):
                            if x["mask"] >> j & 1:
                                cover[x["at"] + j] += 1
                                cover[min(m, x["at"] + j + window)] -= 1
                    out = np.cumsum(cover[:m]) > 0
                    gone.append(int(out.sum()))
                    kept.append(b" ".join([x for x, o in zip(own, out.tolist(), strict=True) if not o] if gone[-1] else own))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept], pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """One row per input row: ``<id>, n_words, n_removed, kept_text``.

    Words are maximal runs without white space. A window of ``window`` words
    (at most 64 pieces of anchors fit a mask: up to 68) that also begins
    earlier, in a smaller id or further up, covers its words, which go.

    1. Windows are cut into pieces by a minimising anchor, so that equal
       windows lie in pieces of one anchor. Anchors seen once can't hold a
       repeat and drop out after a combined count.
    2. Pieces of equal words (anchor, length and a 128-bit digest of the bytes)
       are pre-aggregated to their first occurrence; all windows of the others
       repeat. A hot passage so becomes one row a task, and the way back to
       its pieces is a broadcast of the hot passages (``join_groups``).
    3. The distinct pieces of whole anchors form shards of bounded size. Each
       shard's compressed index (wavelet matrix over the transform, sampled
       places) takes its pieces' matching statistics by backward search where
       windows end; the intervals that reach the window's length and hold an
       earlier place are reported. An anchor with very many pieces is dealt
       out by window content, where equal windows still meet.
    4. The reports go back to the documents, which drop the words.

    Null and empty texts have no words. Every row is a document of its own:
    rows of one id follow each other in the order in which they were read, a
    null id is larger than all others. An empty table gives an empty result;
    further columns are not looked at. Texts are worked on whole, a bounded
    number of bytes at a time.
    """
    if not _ANCHOR <= window <= 64 + _ANCHOR - 1:
        raise ValueError("windows are of 5 to 68 words")
    spark, top = docs.sparkSession, shared_dir(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = rows.mapInArrow(_packed, f"id {kind}, z binary")
    packed = stash(packed.select("id", F.monotonically_increasing_id().alias("rid"), "z"), f"{top}/texts")
    found = packed.mapInArrow(_emit(window), f"id {kind}, rid long, at int, n int, anchor long, content binary")
    twice = stash(found.select("anchor").groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), f"{top}/anchors")
    cand = stash(join_groups(found, twice, {"anchor": "anchor"}, "m", ["m"], ["rid", "at"]).drop("m"), f"{top}/candidates")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid", "at")).alias("first")
    classes = cand.groupBy("anchor", "content", "n").agg(first, F.count(F.lit(1)).alias("m"))
    classes = stash(classes.select("anchor", "content", "n", "first.rid", "first.at", "m"), f"{top}/classes")

    crowd = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor", "k", F.ceil(F.col("k") / _CROWD).cast("int").alias("split"))
    asked = join_groups(classes, crowd, {"anchor": "anchor"}, "k", ["split"], ["rid", "at"])
    ask = asked.groupBy(F.col("rid").alias("of")).agg(F.collect_list(F.struct("at", "split")).alias("ask"))
    wanted = packed.join(ask, F.col("rid") == F.col("of")).select("id", "rid", "z", "ask")
    schema = f"anchor long, sub int, id {kind}, rid long, at int, skip int, words binary"
    dealt = wanted.mapInArrow(_fetch(window), schema).repartition("anchor", "sub").sortWithinPartitions("anchor", "sub")
    marks = stash(dealt.mapInArrow(_search(window), "rid long, at int, mask long"), f"{top}/marks")

    again = classes.where("m > 1").withColumnsRenamed({"rid": "first_rid", "at": "first_at"})
    keys = {"anchor": "anchor", "content": "content", "n": "n"}
    later = join_groups(cand.select("rid", "at", *keys), again, keys, "m", ["first_rid", "first_at"], ["rid", "at"])
    later = later.where((F.col("rid") != F.col("first_rid")) | (F.col("at") != F.col("first_at")))
    marks = marks.unionAll(later.select("rid", "at", F.lit(-1).cast("long").alias("mask")))
    per = marks.groupBy(F.col("rid").alias("of")).agg(F.collect_list(F.struct("at", "mask")).alias("marks"))
    out = packed.join(per, F.col("rid") == F.col("of"), "left").select("id", "z", "marks")
    return out.mapInArrow(_remove(window), f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
