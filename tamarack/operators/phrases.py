"""Repeated runs of words of several sizes, counted exactly without writing every run."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
#: Which runs are kept, by numbers and characters.
Worth = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Bytes of text taken together by a task, and words for which there is a bucket, within bounds.
_CHUNK, _BUCKET, _BUCKETS = 10 << 20, 1_000_000, (16, 2048)
#: Segments counted at once, and phrases in a batch.
_AT_ONCE, _BATCH = 500_000, 100_000
#: Words are told apart as frequent by slots (of their lengths and first eight bytes); a slot of more than one word in so many is frequent, 10000 slots at most.
_FREQUENT, _SLOTS = 10_000, 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of texts with about _CHUNK bytes together, or one longer text."""
    held, size = [], 0
    for batch in batches:
        column = batch.column(0)
        column = column.fill_null("") if column.null_count else column
        offsets, at = _offsets(column), 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK - size, "right")) - 1)
            held.append(column.slice(at, to - at))
            size += int(offsets[to] - offsets[at])
            at = to
            if size >= _CHUNK or at < len(column):
                yield held
                held, size = [], 0
    if held:
        yield held


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, which of them belong to words, where words begin and end, and where texts end."""
    o = _offsets(column)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[o[0] : o[-1]]
    o = o - o[0]
    inner = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[o] = True  # a text's bounds end words
    start, end = inner & edge[:-1], inner & edge[1:]
    start[1:] |= inner[1:] & ~inner[:-1]
    end[:-1] |= inner[:-1] & ~inner[1:]
    return data, inner, np.flatnonzero(start), np.flatnonzero(end) + 1, o[1:]


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Hashes of words by their lengths and first ``most`` bytes, eight at a time."""
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = size.astype(np.uint64) * _B
    for at in range(0, most, 8):
        own = np.flatnonzero(size > at) if at else slice(None)
        kept = np.minimum(size[own] - at, 8).astype(np.uint64) * np.uint64(8)
        out[own] = _mixed(out[own] + (eight[start[own] + at] & (~np.uint64(0) >> (np.uint64(64) - kept))) * _A)
    return out


def _slots(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (_hashes(data, start, size, 8) % np.uint64(_SLOTS)).astype(np.int64)


def _words(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's number, where each text's words begin (and the last ones end), the words by number."""
    sizes, bodies, firsts, base = [], [], [np.zeros(1, np.int64)], 0
    for column in columns:
        data, inner, start, end, texts = _places(column)
        sizes.append(end - start)
        bodies.append(data[inner])
        firsts.append(base + np.searchsorted(start, texts))
        base += len(start)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), base, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(bodies))]).dictionary_encode()
    return words.indices.to_numpy(), np.concatenate(firsts), words.dictionary


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``slot, n``: each chunk's frequent slots; without a slot, the number of all its words."""
    for columns in _chunks(batches):
        n = np.zeros(_SLOTS, np.int64)
        for column in columns:
            data, _, start, end, _ = _places(column)
            n += np.bincount(_slots(data, start, end - start), minlength=_SLOTS)
        top = np.flatnonzero(n * 2 * _FREQUENT >= max(n.sum(), 1))
        yield pa.RecordBatch.from_arrays([pa.array([None, *top.tolist()], pa.int64()), pa.array([n.sum(), *n[top].tolist()], pa.int64())], ["slot", "n"])


def _packed(x: np.ndarray) -> list[bytes]:
    """Numbers by byte, low ones first, each byte compressed by itself; an empty one ends them."""
    z, most, out = zstandard.ZstdCompressor(level=1), int(x.max(initial=0)), []
    while most or not out:
        out.append(z.compress((x >> 8 * len(out)).astype(np.uint8).tobytes()))
        most >>= 8
    return [*out, b""]


def _unpacked(planes: Iterator[bytes], kind: type = np.int32) -> np.ndarray:
    z, out = zstandard.ZstdDecompressor(), None
    for i, plane in enumerate(iter(planes.__next__, b"")):
        x = np.frombuffer(z.decompress(plane), np.uint8).astype(kind)
        out = x if out is None else out | x << 8 * i
    return out


def _segments(first: np.ndarray, rank: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of words, and how many words before and behind each belong to runs of 2 to ``most`` words in which it is the leftmost of least rank; words without such runs stay out."""
    at, count = np.arange(len(rank)), np.diff(first)
    before = np.minimum(at - np.repeat(first[:-1], count), most).astype(np.int16)
    behind = np.minimum(np.repeat(first[1:], count) - 1 - at, most).astype(np.int16)
    left, right = np.zeros(len(rank), np.int16), np.zeros(len(rank), np.int16)
    back, on = np.ones(len(rank), bool), np.ones(len(rank), bool)
    for d in range(1, min(most, len(rank))):
        back[:d] = on[-d:] = False
        later = rank[d:] >= rank[:-d]
        on[:-d] &= later
        back[d:] &= ~later
        back &= before >= d
        on &= behind >= d
        left += back
        right += on
    at = np.flatnonzero((left > 0) | (right > 0))
    return at, left[at], right[at]


def _dealt(frequent: np.ndarray, buckets: int, most: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.zeros(_SLOTS, np.uint64)
        late[frequent] = np.arange(1, len(frequent) + 1)
        yield from filter(None, (_chunk(columns, late, buckets, most) for columns in _chunks(batches)))

    return f


def _chunk(columns: list[pa.Array], late: np.ndarray, buckets: int, most: int) -> pa.RecordBatch | None:
    """A row for each bucket: its words, and by number the segments dealt to it. Arrays go as soon as they aren't needed, since executors run several tasks."""
    z = zstandard.ZstdCompressor(level=3)
    ids, first, own = _words(columns)
    if len(ids) < 2:
        return None
    offsets, body = np.frombuffer(own.buffers()[1], np.int64)[: len(own) + 1], np.frombuffer(own.buffers()[2], np.uint8)
    h, place = _hashes(body, offsets[:-1], np.diff(offsets), 64), late[_slots(body, offsets[:-1], np.diff(offsets))]
    rank = np.where(place > 0, place + np.uint64(1 << 63), h >> np.uint64(1))[ids]
    at, left, right = _segments(first, rank, most)
    start, size = at - left, 1 + left.astype(np.int64) + right
    h = h[ids]
    # Equal segments meet by their first, middle and last words; then they are compared by word.
    key = _mixed(h[start] + _mixed(h[start + size - 1] + _mixed(h[start + (size >> 1)] + h[at] * _A) + left.astype(np.uint64)))
    key = ((h[at] % np.uint64(buckets)) << np.uint64(52)) | (key >> np.uint64(12))
    order = np.argsort(key)
    del h, at, rank
    key, start, size, left, right = key[order], start[order], size[order], left[order], right[order]
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    again = again[(left[again] == left[again - 1]) & (right[again] == right[again - 1])]
    equal = np.ones(len(again), bool)
    for j in range(2 * most - 1):
        equal &= (size[again] <= j) | (ids[np.minimum(start[again] + j, len(ids) - 1)] == ids[np.minimum(start[again - 1] + j, len(ids) - 1)])
    head = np.ones(len(key), bool)
    head[again[equal]] = False
    head = np.flatnonzero(head)
    times = np.diff(np.append(head, len(key)))
    order = np.argsort((key[head] >> np.uint64(52) << np.uint64(40)) | start[head].astype(np.uint64))
    head, times = head[order], times[order].astype(np.int32)
    key, start, size, left, right = key[head] >> np.uint64(52), start[head], size[head], left[head], right[head]
    bound = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64))
    rows = {"bucket": [], "parts": []}
    for b in np.flatnonzero(np.diff(bound)).tolist():
        s = slice(bound[b], bound[b + 1])
        n = size[s]
        codes, found = pd.factorize(ids[np.repeat(start[s] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        codes = codes.astype(np.int32)
        rank = np.argsort(-np.bincount(codes))
        place = np.empty(len(rank), np.int32)
        place[rank] = np.arange(len(rank), dtype=np.int32)
        words = own.take(pa.array(found[rank]))
        offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
        rows["bucket"].append(b)
        rows["parts"].append([z.compress(words.buffers()[2].to_pybytes()[: offsets[-1]]), *_packed(np.diff(offsets)), *_packed(place[codes]), *_packed(left[s]), *_packed(right[s]), *_packed(times[s])])
    return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), pa.array(rows["parts"], pa.list_(pa.binary()))], ["bucket", "parts"])


def _repeated(ids: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, times: np.ndarray, sizes: Collection[int], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, first words' places and numbers of the runs that occur ``least`` times.

    A run's place about its word of least rank follows from its words, so runs
    are counted by size and place. A run is named by the number of the run one
    word shorter and that word, so equal numbers are equal words; one that is
    rarer than ``least`` isn't continued.
    """
    known: dict[int, np.ndarray] = {}
    for k in range(1, max(sizes) + 1):
        now = {}
        for a in range(k):
            r = k - 1 - a
            if k == 1:
                own = np.arange(len(at))
                key = ids[at].astype(np.int64)
            else:
                open_ = (left >= a) & (right >= r)
                if r:
                    open_ &= known[a] >= 0
                if a:
                    open_ &= known[a - 1] >= 0
                own = np.flatnonzero(open_)
                key = known[a if r else a - 1][own].astype(np.int64) << 32 | ids[at[own] + r if r else at[own] - a]
            codes, found = pd.factorize(key)
            n = np.bincount(codes, weights=times[own], minlength=len(found)).astype(np.int64)
            some = np.empty(len(found), np.int64)
            some[codes] = own
            paid = n >= least
            if k in sizes and paid.any():
                yield k, at[some[paid]] - a, n[paid]
            now[a] = np.full(len(at), -1, np.int32)
            now[a][own] = np.where(paid, np.arange(len(found), dtype=np.int32), np.int32(-1))[codes]
        known = now


def _phrases(words: pa.Array, ids: np.ndarray, k: int, begin: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(n), _BATCH):
        b = begin[i : i + _BATCH]
        text = pc.binary_join_element_wise(*[words.take(pa.array(ids[b + j])) for j in range(k)], pa.scalar(b" ", words.type))
        yield pa.RecordBatch.from_arrays([text.view(pa.large_string()).cast(pa.string()), pa.array(n[i : i + _BATCH])], ["phrase", "n"])


def _counted(sizes: Collection[int], least: int, worth: Worth | None):
    def bucket(rows: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        words, ids, left, right, times = [], [], [], [], []
        for body, *planes in rows:
            planes = iter(planes)
            offsets = np.concatenate([[0], np.cumsum(_unpacked(planes, np.int64))])
            words.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(z.decompress(body))]))
            for x, kind in ((ids, np.int32), (left, np.int16), (right, np.int16), (times, np.int32)):
                x.append(_unpacked(planes, kind))
        coded = pa.chunked_array(words).dictionary_encode().combine_chunks()
        own, first = coded.indices.to_numpy(), np.cumsum([0, *map(len, words)])
        ids = np.concatenate([own[f : f + len(w)][x] for f, w, x in zip(first, words, ids, strict=False)])
        left, right, times = map(np.concatenate, (left, right, times))
        size = 1 + left.astype(np.int64) + right
        at = np.cumsum(size) - size + left
        chars = pc.utf8_length(coded.dictionary.view(pa.large_string())).to_numpy().astype(np.int64)
        parts = -(-len(at) // _AT_ONCE)
        part = _mixed(ids[at].astype(np.uint64) * _A) % np.uint64(parts)
        for p in range(parts):
            s = np.flatnonzero(part == p)
            for k, begin, n in _repeated(ids, at[s], left[s], right[s], times[s], sizes, least) if len(s) else ():
                if worth:
                    kept = worth(n, sum(chars[ids[begin + j]] for j in range(k)) + k - 1)
                    begin, n = begin[kept], n[kept]
                yield from _phrases(coded.dictionary, ids, k, begin, n)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for b, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != now and held:
                    yield from bucket(held)
                    held = []
                now = b
                held.append(parts.as_py())
        if held:
            yield from bucket(held)

    return f


def repeated_phrases(docs: DataFrame, sizes: Collection[int], text_col: str = "text", least: int = 2, worth: Worth | None = None) -> DataFrame:
    """``phrase, n``: every run of words of one of ``sizes`` (2 or more each) that occurs ``least`` times in all texts, its words joined by one space; of these the ones that ``worth`` takes by number and characters.

    A run meets its equals in the bucket of its word of least rank (the
    leftmost of equal ones). So instead of each run, a word is sent once, with
    the words about it of all runs in which it is that word: about four words
    for each of a text, written as numbers and compressed; equal segments of a
    chunk go once with their number. Frequent words rank behind all others,
    the most frequent last, so that no bucket gets all that is about one of
    them; the rest rank by hash. Hashes and ranks only deal out; words decide.
    Reads the texts twice: at the call, for the frequent words and the number
    of words.
    """
    if min(sizes) < 2:
        raise ValueError("runs have two words or more")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    often = texts.mapInArrow(_often, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    top = often.orderBy(F.col("slot").isNotNull(), F.desc("n"), "slot").limit(_FREQUENT + 1).collect()
    total = top[0].n if top else 0
    frequent = np.array([r.slot for r in reversed(top[1:]) if r.n * _FREQUENT >= total], np.int64)
    buckets = min(max(total // _BUCKET, _BUCKETS[0]), _BUCKETS[1])
    dealt = texts.mapInArrow(_dealt(frequent, buckets, max(sizes)), "bucket int, parts array<binary>")
    return dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_counted(frozenset(sizes), least, worth), "phrase string, n long")
