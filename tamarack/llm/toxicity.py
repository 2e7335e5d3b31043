"""Toxicity by compression distance: window lengths under zstandard dictionaries trained on toxic and on ordinary text."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._labelled import fitted, held_out

#: Labelled rows that are learnt from, ordinary and toxic, at most.
MOST = (4000, 2000)
#: Words of a window.
WINDOW = 5
#: Bytes of a stem. Words that share more have a stem of the most bytes in common, so none is lost, and a long run without white space costs no more than its length.
STEM, LONGEST = 6, 64
#: Bytes of a segment that the trainer takes at once, and of a dictionary at most.
SEGMENT, LARGEST = 32, 1 << 16
#: Times that a word or stem is trained on.
OFTEN = 8
#: Begins each window and ends both dictionaries. Its match pays for the first sequence of a frame, so that any further one shows.
_LEAD = bytes(range(1, 13))
#: Thresholds of a window's difference, in bytes.
_STEPS = (2, 3, 4, 5, 7)


def tokens(text: str) -> list[bytes]:
    """Words without white space, A-Z lower-cased."""
    return text.encode().lower().split()


def _spread(texts: list[str], among: Container[bytes] | None = None) -> tuple[Counter[bytes], int]:
    """In how many texts each word, and each stem of STEM to LONGEST bytes that begins one, occurs in a context that no earlier text has; and the sum over whole words.

    A context is the word with its neighbours, so copies and shared passages
    count once, while unlike texts count each. ``among`` bounds what is counted.
    """
    w = _text.words(pa.array(texts, pa.string()), lower=True)
    before, after = np.zeros_like(w.hash), np.zeros_like(w.hash)
    before[1:], after[:-1] = w.hash[:-1], w.hash[1:]
    edge = w.first[(w.first > 0) & (w.first < len(w.hash))]
    before[edge], after[edge - 1] = 0, 0
    new = np.zeros(len(w.hash), bool)
    new[np.unique(_text.mixed(_text.mixed(_text.mixed(before) + w.hash) + after), return_index=True)[1]] = True
    seen, total = Counter(), 0
    for a, b in itertools.pairwise(w.first):
        own = {w.word(k) for k in a + np.flatnonzero(new[a:b])}
        parts = own | {x[:k] for x in own for k in range(STEM, min(len(x), LONGEST + 1)) if x[k] & 0xC0 != 0x80}
        seen.update(parts if among is None else (x for x in parts if x in among))
        total += len(own)
    return seen, total


def telling(own: list[str], other: list[str]) -> set[bytes]:
    """Words and stems that occur in more texts than the other class lets expect.

    One qualifies when its log-likelihood ratio is over twice the logarithm of
    how many were tried, so that chance hardly lets one in, however many there
    are.
    """
    a, n_own = _spread(own)
    a = {x: n for x, n in a.items() if n >= 4}
    b, n_other = _spread(other, a)
    least, out = 2 * np.log(len(a) + 1), set()
    for x, n in a.items():
        expected = (b[x] + 0.5) / max(1, n_other) * n_own
        if n > expected and n * np.log(n / expected) - (n - expected) > least:
            out.add(x)
    return out


def dictionary(own: list[str], other: list[str]) -> bytes:
    """A dictionary that zstandard trains on the class's texts.

    What both classes write alike would fill it, so each text is trained on
    without the words that don't set the classes apart (``telling``), and
    without those it has seen OFTEN times, lest the frequent crowd out the rest. The
    trainer picks the segments that cover most; it has room for all words four
    times over and takes what it needs. Where the texts are too few to train
    on, they are the dictionary themselves.
    """
    marks, seen = telling(own, other), Counter()
    samples = []
    for text in own:
        rest = []
        for w in tokens(text):
            mark = next((w[:k] for k in range(STEM, min(len(w), LONGEST + 1)) if w[:k] in marks), w if w in marks else None)
            if mark and seen[mark] < OFTEN:
                seen[mark] += 1
                rest.append(w)
        if rest:
            samples.append((b" " + b" ".join(rest) + b" ").ljust(8))
    size = sum(len(w) + 1 for w in {w for x in samples for w in x.split()})
    try:
        content = zstandard.train_dictionary(min(LARGEST, max(512, 4 * size)), samples, k=SEGMENT, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        content = b"".join(dict.fromkeys(samples))[-LARGEST:]
    return content + b" " + _LEAD


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    press: tuple | None = field(default=None, repr=False)

    def open(self) -> Model:
        size = max(len(self.toxic), len(self.ordinary)).bit_length()  # tables and window hold the whole dictionary
        how = zstandard.ZstdCompressionParameters(
            window_log=max(14, size + 1), chain_log=max(12, size), hash_log=max(12, size), search_log=4, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTOPT,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )

        def press(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress

        self.press = press(self.ordinary), press(self.toxic)
        return self

    def differences(self, text: str) -> np.ndarray:
        """By how many bytes each window is shorter with the toxic dictionary."""
        words = tokens(text)
        ordinary, toxic = self.press
        out = []
        for i in range(0, len(words), WINDOW):
            w = _LEAD + b" " + b" ".join(words[i : i + WINDOW]) + b" "
            out.append(len(ordinary(w)) - len(toxic(w)))
        return np.array(out or [0])

    def features(self, text: str) -> list[float]:
        d = self.differences(text)
        return [*(np.log1p((d >= k).sum()) for k in _STEPS), np.log1p((d >= 3).mean() * 100), np.log1p(d.clip(0).sum()), min(d.max(), 8), np.log(len(d))]

    def score(self, text: str) -> float:
        z = (np.array(self.features(text)) - self.shift) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -40, 40))))


def fit(texts: list[str], labels: list[int], counts: tuple[int, int]) -> Model:
    """Dictionaries from three rows of five, calibrated on the others by a logistic regression.

    Rows weigh so that classes have their share of all labels. With no rows of
    one class the score is that share for all texts.
    """
    n = len(_STEPS) + 4
    prior = (counts[1] + 1) / (sum(counts) + 2)
    flat = Model(_LEAD, _LEAD, np.array([0.0] * n + [np.log(prior / (1 - prior))]), np.zeros(n), np.ones(n))
    pairs = list(dict.fromkeys(zip(texts, labels, strict=True)))  # copies count once
    by = [[t for t, y in pairs if y == c] for c in (0, 1)]
    learn = [[t for i, t in enumerate(p) if i % 5 < 3] for p in by]
    rest = [[t for i, t in enumerate(p) if i % 5 >= 3] for p in by]
    if not all(learn) or not all(rest):
        return flat
    m = Model(dictionary(learn[1], learn[0]), dictionary(learn[0], learn[1]), flat.weights, flat.shift, flat.scale).open()
    x = np.array([m.features(t) for t in rest[0] + rest[1]])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    w = np.repeat([counts[0] / len(rest[0]), counts[1] / len(rest[1])], [len(rest[0]), len(rest[1])])
    w *= len(w) / w.sum()
    m.shift, m.scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - m.shift) / m.scale, np.ones(len(x))]
    b, ridge = np.zeros(n + 1), np.diag([1.0] * n + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        b = b - np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (p - y)) + ridge @ b)
    m.weights, m.press = b, None
    return m


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs``, all columns, with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Learns from up to MOST labelled rows of each class of ``labels`` (columns
    ``<id>, toxic``) that aren't held out: a dictionary trained on each class,
    then a calibration of how much shorter windows of WINDOW words come out
    under the toxic one. Every text is scored whole, from its text alone.

    Null and empty texts get the score of a text without telling windows; null
    ids aren't held out. Without labels of both classes all scores are the
    class's share. Rows stay as they come; columns named like the three new
    ones are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fitted(docs, labels, "toxic", MOST, fit, id_col, text_col))
    new = ("held_out", "score", "predicted")
    rows = docs.drop(*new)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value.open()
        for batch in batches:
            score = pa.array([m.score(t.as_py() or "") for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    scored = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.select(*[F.col(f"`{c}`") for c in rows.columns], held_out(F.col(f"`{id_col}`")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
