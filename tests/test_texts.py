from pyspark.sql import functions as F

from tamarack.functions import texts
from tamarack.operators import search


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_indents_go_and_come_back(spark):
    text = "a\n  b\n    c\n\n  d  e"
    small = one(spark, text, texts.compress_indent)
    assert small == "a\n b\n  c\n\n d  e"
    assert one(spark, small, texts.expand_indent) == text


def test_whitespace_keeps_the_indent(spark):
    assert one(spark, "key:  value  \n   next:   line  ", texts.normalize_whitespace) == "key: value\n   next: line"


def test_truncation(spark):
    cut = lambda t, n: one(spark, t, lambda c: texts.truncate_at_sentence(c, n))
    assert [cut("One. Two three", 8), cut("one two three", 9), cut("onetwothree", 4), cut("short", 5), cut(None, 5)] == ["One.…", "one two…", "onet…", "short", None]


def test_durations(spark):
    got = [one(spark, v, texts.format_duration, "long") for v in (59999, 60000, 61000, 3600000, 3723000, None)]
    assert got == ["59s", "1m", "1m 1s", "1h 0m", "1h 2m 3s", None]


def test_score_bands(spark):
    df = spark.createDataFrame([(0.1,), (0.4,), (0.7,), (0.8,), (None,)], "s double")
    got = [tuple(r) for r in df.select(texts.score_label(F.col("s")), texts.score_profile(F.col("s"))).collect()]
    assert got == [("low", "structure"), ("good", "standard"), ("high", "tokenizer"), ("excellent", "semantic"), (None, None)]


def test_facts(spark):
    got = one(spark, "We DECIDED to keep Postgres for now!\nversion 12.4.1, the deadline is: Friday.", texts.facts)
    assert [tuple(r) for r in got] == [("decision", "to keep Postgres for now"), ("fact", ": Friday"), ("fact", "12.4.1, the deadline is: Friday")]
    assert one(spark, None, texts.facts) == []


def test_best_lines_ranks_equal_sums_by_place(spark):
    """ln(7/3) + ln(15/7) is ln(5) but for the last bit: the first line stands before the last."""
    docs = spark.createDataFrame([(1, "\n".join(["fox hen"] * 4 + ["fox", "hen", "hen", "pond"]))], "doc_id int, text string")
    assert [r.pos for r in search.best_lines(docs, "fox hen pond", 1).collect()] == [0]


def test_best_lines_and_tools(spark):
    docs = spark.createDataFrame([(1, "red fox\nred hen\nblue fox pond"), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.id, r.pos) for r in search.best_lines(docs, "find the red pond", 2).orderBy("id", F.desc("score"), "pos").collect()]
    assert got == [(1, 2), (1, 0)]
    assert search.best_lines(docs, "the", 2).count() == 0
    tools = spark.createDataFrame([(1, "read_file", None), (2, "search", "reads files"), (3, "x", "y")], "id int, n string, d string")
    assert [tuple(r) for r in search.best_tools(tools, "reads file", 5, "n", "d", "id").collect()] == [(2, 2)]
