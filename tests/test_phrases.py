"""Repeated runs of words: against counting each run, and what is written on the way."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tamarack.operators import phrases, text


def brute(texts, sizes, least=2):
    n = Counter()
    for t in texts:
        w = [x for x in re.split(r"[ \t\n\r]+", t or "") if x]
        n.update(" ".join(w[i : i + k]) for k in sizes for i in range(len(w) - k + 1))
    return {p: c for p, c in n.items() if c >= least}


@pytest.mark.parametrize("vocabulary,chunk,frequent", [(1, 1 << 20, False), (2, 300, True), (5, 1000, True), (40, 2000, False), (3000, 5000, True)])
def test_runs_of_all_sizes(monkeypatch, vocabulary, chunk, frequent):
    """Few words (runs of one word, ties), chunks within the table, parts within a bucket, odd spaces, nulls, copies."""
    draw = random.Random(vocabulary)
    words = [draw.choice("abé中\x0b\x0c ") * draw.randint(1, 3) + str(i) * (i % 7 * 4) for i in range(vocabulary)]
    texts = ["".join(draw.choice(words) + draw.choice([" ", " ", "\n", " \t\r "]) for _ in range(draw.randint(0, 60))) for _ in range(200)]
    texts += [None, "", " ", *texts[:20], "x" * 500 + " y", "x" * 500 + " y", "x" * 500 + "z y"]
    monkeypatch.setattr(phrases, "_CHUNK", chunk)
    monkeypatch.setattr(phrases, "_AT_ONCE", 50)
    monkeypatch.setattr(phrases, "_BATCH", 7)
    batches = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    batches = [batches.slice(3, 90), batches.slice(93), batches.slice(0, 3)]
    often = [r for b in phrases._often(iter(batches)) for r in b.to_pylist()]
    assert sum(r["n"] for r in often if r["slot"] is None) == sum(len(re.findall(r"[^ \t\n\r]+", t or "")) for t in texts)
    slots = np.array(sorted({r["slot"] for r in often if r["slot"] is not None}) if frequent else [], np.int64)
    dealt = pa.Table.from_batches(phrases._dealt(slots, 3, 8)(iter(batches))).sort_by("bucket").combine_chunks()
    for sizes, least in ((range(2, 9), 2), ((3, 5), 4), ((8,), 1)):
        rows = [(r["phrase"], r["n"]) for b in phrases._counted(frozenset(sizes), least, None)(iter(dealt.to_batches(max_chunksize=2))) for r in b.to_pylist()]
        assert len(rows) == len(dict(rows)) and dict(rows) == brute(texts, sizes, least)


def test_candidates_write_less_than_the_text(spark):
    """Each run of 2 to 8 words by itself is 35 words for each of the text."""
    draw = random.Random(1)
    texts = [" ".join(f"word{int(draw.paretovariate(0.6)) % 20000}" for _ in range(300)) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    written = lambda: sum(s.shuffleWriteBytes() for s in stages(spark))
    before = written()
    got = {r.phrase: r.n for r in text.phrase_candidates(docs, range(2, 9)).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    pays = lambda p, n: (-(-len(p) // 4) - 1) * n > -(-len(p) // 4) + 3
    assert got == {p: n for p, n in brute(texts, range(2, 9)).items() if pays(p, n)} and len(got) > 1000
    assert written() - before < 2 * sum(map(len, texts))


def stages(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_sizes_of_one_word(spark):
    docs = spark.createDataFrame([("extraordinarily long " * 9,)], "text string")
    got = {r.phrase: r.n for r in text.phrase_candidates(docs, [1, 2]).collect()}
    assert got == {"extraordinarily": 9, "extraordinarily long": 9, "long extraordinarily": 8}
    with pytest.raises(ValueError):
        phrases.repeated_phrases(docs, [1, 2])
