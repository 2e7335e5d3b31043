import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tamarack import functions as fn
from tamarack.operators import context, deltas, text
from tamarack.streaming import call_stream, running_stats


def test_exact_delta_keeps_nulls(spark):
    rows = [(1, i, v) for i, v in enumerate([None, None, "a", "a", None, "b", "b"])]
    w = Window.partitionBy("g").orderBy("i")
    df = spark.createDataFrame(rows, "g int, i int, v string").withColumn("cell", deltas.exact(F.col("v"), w))
    back = df.withColumn("again", deltas.exact_back(F.col("cell"), w)).orderBy("i").collect()
    assert [r.cell for r in back] == [None, "~", "a", "~", None, "b", "~"]
    assert [r.again for r in back] == [r.v for r in back]


def test_greedy_packing_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 0, 6), (1, 1, 5), (1, 2, 4)], "k int, at int, t int")
    assert context.packed(df, "k", [F.col("at")], "t", 10).first().asDict() == {"k": 1, "used": 10, "n_kept": 2, "n_items": 3}


@pytest.mark.parametrize(("value", "want"), [('{"a": 1}', "json"), ("a,b\n1,2\n3,4", "csv"), ("# T\n\n- a\n- b", "markdown"), ("a: 1\nb: 2", "yaml"), ("just words", "text"), ("", "text"), (None, "text")])
def test_detect(spark, value, want):
    assert spark.createDataFrame([(value,)], "t string").select(fn.detect_format(F.col("t"))).first()[0] == want


def test_scalars(spark):
    one = spark.createDataFrame([("4111111111111111", -2.5, "https://a http://b")], "d string, x double, u string")
    r = one.select(fn.luhn_valid(F.col("d")), fn.half_up(F.col("x")), fn.shorten_urls(F.col("u")), fn.alias_name(F.lit(27))).first()
    assert tuple(r) == (True, -2, "h//a h/b", "$ab")


def test_line_runs_and_repeats(spark):
    df = spark.createDataFrame([(1, "x\nx\nx\ny\nlonger than ten\ny\nlonger than ten"), (2, None)], "doc_id int, text string")
    assert {r.id: (r.n_runs, r.n_collapsed) for r in text.line_runs(df).collect()} == {1: (1, 2), 2: (0, 0)}
    assert {r.id: (r.n_lines, r.n_repeats) for r in text.first_lines(df).collect()} == {1: (7, 1), 2: (1, 0)}


def test_running_stats(spark, tmp_path):
    call = {"action": "compress", "format": "json", "input_tokens": 10, "output_tokens": 4, "timestamp": 0}
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(call)] * 3))
    q = running_stats(call_stream(spark, str(tmp_path))).writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("running").collect()] == [("json", 3, 18)]


def test_phrases_of_all_sizes(spark):
    texts = ["one two three four five six seven eight nine", "zero one two three four five six seven eight", "nine  one\ntwo", "one", None]
    count = {}
    for t in texts:
        w = (t or "").split()
        for k in range(2, 9):
            for i in range(len(w) - k + 1):
                count[" ".join(w[i : i + k])] = count.get(" ".join(w[i : i + k]), 0) + 1
    want = {p: n for p, n in count.items() if n >= 2 and (-(-len(p) // 4) - 1) * n > -(-len(p) // 4) + 3}
    got = text.phrase_candidates(spark.createDataFrame([(t,) for t in texts], "text string"), range(2, 9))
    assert {r.phrase: r.n for r in got.collect()} == want and {len(p.split()) for p in want} >= {5, 8}


def test_substring_widths(spark):
    widths = lambda *values: text.window_widths(spark.createDataFrame([(v,) for v in values], "v string"), "v")
    assert widths("x" * 70, "y" * 50) == (64, 48, 40, 32, 24, 20, 16, 12, 10, 8, 6)
    assert widths("x" * 21, "y" * 20, None) == (20, 16, 12, 10, 8, 6)
    assert widths("abcdefg", "a", "b" * 12) == (12, 10, 8, 6, 5) and widths("abcdefg", "abcdefg", "b" * 12, None) == (12, 10, 8, 6)
    assert widths("abcde") == widths(None) == ()
    v = spark.createDataFrame([("p" * 24 + "one",), ("p" * 24 + "two",), ("ab",)], "v string")
    parts = {r.part for r in text.substring_candidates(v, "v", text.window_widths(v, "v")).collect()}
    assert {len(p) for p in parts} == {24}
    assert text.substring_candidates(v, "v", ()).count() == 0


def test_temporal_delta_round_trip(spark):
    iso = lambda zone, *times: [f"2026-03-29T{t}{zone}" for t in times]
    times = ("01:59:59", "02:00:00", "02:00:00", "23:59:59", "00:00:00")
    groups = {1: iso("Z", *times), 2: iso("-05:30", *times), 3: iso("", *times), 4: iso("Z", *times)[:3] + iso("+01:00", *times)[:2], 5: ["T+60", '"T-1', "T+x", None, "2026-03-29T01:00:00Z"]}
    groups |= {6: iso("Z", "01:00:00", "01:00:01"), 7: iso("Z", *["01:00:00"] * 4), 8: iso(".5Z", *times), 9: ["2026-02-30T00:00:00Z", *iso("Z", *times)]}
    df = spark.createDataFrame([(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)], "g int, i int, v string")
    coded = deltas.temporal(df, "v", ["g"], "i", "cell")
    back = deltas.temporal_back(coded.drop("v"), "cell", ["g"], "i", "again").join(df, ["g", "i"]).orderBy("g", "i").collect()
    assert [r.again for r in back] == [r.v for r in back]
    cells = {g: [r.cell for r in back if r.g == g] for g in groups}
    for g, zone in ((1, "Z"), (2, "-05:30"), (3, "")):
        assert cells[g] == [f"2026-03-29T01:59:59{zone}", "T+1", f"2026-03-29T02:00:00{zone}", "T+79199", "T-86399"]
    assert all(cells[g] == groups[g] for g in (4, 6, 7, 8, 9)) and cells[5][:2] == ['"T+60', '""T-1']
    save = {r.g: (r.n_rows, r.plain, r.coded, r.pays) for r in deltas.temporal_savings(df, "v", ["g"], "i").collect()}
    assert save[1] == (5, 100, 20 + 3 + 1 + 7 + 7, True) and save[4] == (5, 115 - 5, 110, False) and not save[7][3]
    # A whole time begins anew, in its own zone; a step above all times stays.
    rows = [(1, k, v) for k, v in enumerate(["T+1", "2026-01-01T00:00:00Z", "T+1", "2026-01-01T00:00:00+02:00", "T-1"])]
    again = deltas.temporal_back(spark.createDataFrame(rows, "g int, i int, c string"), "c", ["g"], "i", "v").orderBy("i").collect()
    assert [r.v for r in again] == ["T+1", "2026-01-01T00:00:00Z", "2026-01-01T00:00:01Z", "2026-01-01T00:00:00+02:00", "2025-12-31T23:59:59+02:00"]


@pytest.mark.parametrize(("lines", "want"), [(["a,b"] * 50 + ["Then prose, with one, two and three, commas and so on."] * 20, "text"), (["a,b,c"] + ["x"] * 12 + ["1,2,3"] * 60, "csv")])
def test_detect_counts_all_lines(spark, lines, want):
    assert spark.createDataFrame([("\n\n".join(lines),)], "t string").select(fn.detect_format(F.col("t"))).first()[0] == want
