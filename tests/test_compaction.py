"""Parsers, sinks, detection, layers, checks, tools and sessions: round trips over generated values, and cases by hand."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tamarack.functions import code, detect, documents, formats, layers, lossy, tokens, tools
from tamarack.operators import context, deltas, engine, text
from tamarack.sources import logs

ATOMS = [None, True, False, 1, -2, 3.5, "", "a b", "true", "12", "- x", "a: b", "#h", " lead", "é", "it's", 'q"q', "two\nlines", "{}", "$a", "${a}", "$$", "(×2)", "x (×3)", "pa|pe", "~", "+5", "T+3", "“q”", "a – b", "@from json"]


def value(rng, depth=0):
    k = rng.random()
    if depth > 3 or k < 0.5:
        return rng.choice(ATOMS)
    if k < 0.75:
        return {rng.choice(["a", "b c", "d:e", "x-1", "", " y", "_root"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_yaml_round_trip():
    rng = random.Random(0)
    for _ in range(3000):
        v = value(rng)
        assert formats.parse_yaml(formats.to_yaml(v)) == v


def test_parsers():
    assert formats.parse_csv('a,"b,c";d\n1,"x ""y"""\n,true\n') == [{"a": 1, "b,c;d": 'x "y"'}, {"a": "", "b,c;d": True}]
    assert formats.parse_csv("one line") == [{"_line": "one line"}]
    assert formats.parse_csv("a;b\n1;007\nnull;2e3")[0] == {"a": 1, "b": "007"}
    assert formats.sniff(["a\tb", "1\t2"]) == "\t" and formats.sniff(["a b", "c"]) == ","
    assert formats.parse_json('{"u": "http://x /* no */", // yes\n "v": 1 /* gone */}') == {"u": "http://x /* no */", "v": 1}
    assert formats.parse_yaml("# c\n---\na:\n- 1\n- k: v\n  l: 2\nb: 'it''s'\nc: ~\n") == {"a": [1, {"k": "v", "l": 2}], "b": "it's", "c": None}
    with pytest.raises(ValueError):
        formats.parse_json('{"a": NaN}')
    assert formats.to_csv([{"a": None, "b": 'x"y,'}]) == 'a,b\r\n,"x""y,"'
    with pytest.raises(ValueError):
        formats.to_csv([1, 2])
    assert formats.to_markdown({"a": 1, "b": {"c": [{"d": "x|y"}]}}) == "**a**: 1\n\n## b\n\n### c\n\n| d |\n| --- |\n| x\\|y |"
    assert formats.to_text({"a": [1, {"b": 2}]}) == "a:\n  - 1\n  - b: 2"
    assert formats.widths([{"a": 1, "long": "x"}, {"a": 12345, "long": None}]) == {"a": 5, "long": 4}


@pytest.mark.parametrize(
    ("body", "form"),
    [
        ('{"a": 1}', "json"), ('{"a": 1 // c\n}', "json"), ("a,b\n1,2\n3,4", "csv"), ("a;b\n1;2\n3;4", "csv"), ("# T\n\nprose", "markdown"), ("a: 1\nb:\n  - c\n", "yaml"),
        ("plain words, and more words", "text"), ("@from json\na: 1", "compact"), ("HTTP/1.1 200 OK\nX: y\n\n[1]", "json"), ("", "text"), ("1,2\n3,4\n5,6", "text"),
    ],
)
def test_detection(body, form):
    assert detect.detect(body).format == form


def test_long_csv_is_judged_whole():
    assert detect.detect("a,b,c\n" * 60 + "and then prose without any\n" * 60).format != "csv"


def test_layers_round_trip():
    rng = random.Random(1)
    words = [*ATOMS, "long brand name alpha", "https://ex.org/path/one", "https://ex.org/path/two"]
    used = 0
    for i in range(800):
        v = {"rows": [{"a": rng.choice(words), "b": rng.choice(words), "c": i} for _ in range(rng.randrange(1, 12))], "x": value(rng)}
        for wanted in ((1,), (1, 2), (1, 2, 3)):
            got = layers.compact(json.dumps(v), wanted)
            assert layers.decompact(got.text)[0] == v and not got.lossy
            used += got.entries > 0
        layers.compact(json.dumps(v), (1, 2, 3, 4, 5), budget=20)
    assert used > 30
    for _ in range(800):
        t = "\n".join(rng.choice(["the quick brown fox jumps", "@L0", "@x", "$a and $$", "", "the quick brown fox jumps over", "abc"]) for _ in range(rng.randrange(12)))
        assert layers.expand_text(layers.compact_text(t)) == t
        assert layers.expanded(layers.compact(t, form="text").text) == t


def test_layers_save():
    rows = [{"city": "San Francisco Bay", "k": i} for i in range(50)]
    got = layers.compact(json.dumps(rows))
    assert got.entries == 1 and got.tokens_after < got.tokens_before / 2
    assert json.loads(layers.expanded(got.text)) == rows
    assert layers.expanded(got.text, "csv").startswith("city,k\r\n") and layers.expanded("no compact text") == "no compact text"
    merged = layers.merge_dict(got.text, {"$a": "other", "$b": "more"})
    assert layers.split_dict(merged)[0] == {"$a": "San Francisco Bay", "$b": "more"}
    assert layers.entry_uses(got.text) == {"$a": 50}
    lossy_ = layers.compact(json.dumps([{"t": "x" * 80, "n": None, **{f"f{i}": None for i in range(9)}}] * 30), (1, 2, 4), budget=10)
    assert lossy_.lossy and layers.decompact(lossy_.text)[2]


def test_lossy_steps():
    assert layers.cut_lists(list(range(12))) == [0, 1, 2, "... (7 more)", 10, 11]
    assert layers.cut_values("x" * 51) == "x" * 40 + "..." and layers.cut_values("x" * 50) == "x" * 50
    assert len(layers.cut_fields({str(i): None for i in range(10)})) == 7 and len(layers.cut_fields({str(i): None for i in range(8)})) == 8
    assert layers.cut_runs([{"a": 1}, {"a": 2}, {"a": 3}, 4]) == [{"a": 1}, "... (2 identical)", 4]
    assert layers.fewer_decimals("a 1.005 -2.3456 1.25 v1.2.345") == "a 1.00 -2.35 1.25 v1.2.345"
    assert layers.short_words('The Configuration of DATABASE\n"database"') == 'The Config of DB\n"database"'
    assert layers.longer(layers.shorter("see https://x.y and http://z at 2024-01-02T03:04:00Z")) == "see https://x.y and http://z at 2024-01-02T03:04Z"
    assert layers.restore_characters(*layers.plain_characters("“a” – b’s")) == "“a” – b’s"


def test_documents():
    v = [{"city": "San Francisco Bay", "k": i} for i in range(8)]
    good = layers.compact(json.dumps(v)).text
    assert documents.validate(good) == []
    bad = good.replace("[8]", "[3]").replace("@end\n", "")
    assert {x["code"] for x in documents.validate(bad)} == {"E003", "E007"}
    assert layers.decompact(documents.repair(bad))[0] == v and documents.repair("@from json\n: :") is None
    codes = {x["code"] for x in documents.validate("@from xx\n@dict\n@dict\n  $b: x\n@end\n@end\nk [2]{a|b}:\n  1|2|3\nz: $a \n y: 1\n@compress semantic")}
    assert codes == {"E002", "E003", "E004", "E005", "E006", "E007", "E008", "W001", "W002", "W003"}
    got = documents.interpret(f"Here:\n```\n{bad}\n```\n")
    assert json.loads(got["value"]) == v and got["repaired"]
    assert documents.interpret('{"a": 1}')["format"] == "json" and documents.interpret("no")["format"] == "text"
    page = "---\na: 1\nb: 2\n---\n# T\n```python\nx = [1]\n```\n~~~json\n" + json.dumps(v, indent=1) + "\n~~~\na,b\n1,2\n3,4\n\n[1, 2]\n"
    assert [(b.kind, b.form) for b in documents.blocks(page)] == [("front matter", "yaml"), ("fence", "json"), ("csv", "csv"), ("json", "json")]
    mixed = documents.compact_mixed(page)
    assert len(mixed) < len(page) and json.loads(documents.expand_mixed(mixed).split("~~~json\n")[1].split("\n~~~")[0]) == v
    assert not documents.overlaps(2, 4, [(0, 2), (4, 6)]) and documents.overlaps(1, 3, [(0, 2), (4, 6)])
    s = documents.score(json.dumps(v))
    assert s["schema"] == 1.0 and s["label"] in ("good", "high")
    why = documents.explain(json.dumps(v))
    assert (why["keys"], why["unique_keys"], why["lists"], why["tables"], why["depth"], why["advice"]) == (16, 2, 1, 1, 2, "compact")
    assert why["entries"][0]["uses"] == 8 and "San Francisco Bay" in documents.pretty(good)


def test_code():
    python = 'import os\n\n\n\ndef f(x):  # gone\n    """doc # kept"""\n    return x + "# kept"  \n'
    assert code.compact_code(python) == 'import os\n\ndef f(x):\n    """doc # kept"""\n    return x + "# kept"'
    c = 'function f() { // gone\n  const u = "http://kept"; /* gone\n */\n  return /\\/\\/[/]*/.test(u) ? `// ${u}` : 1;\n}\n'
    assert code.compact_code(c) == 'function f() {\n  const u = "http://kept";\n\n  return /\\/\\/[/]*/.test(u) ? `// ${u}` : 1;\n}'
    broken = "int f() {\n  /* open\n  return 1;\n}\n"
    assert code.compact_code(broken) == broken and code.compact_code("prose\nwith\nlines") == "prose\nwith\nlines"


def test_tools():
    tool = {"name": "t", "description": "One. Two three", "title": None, "parameters": {"type": "object", "properties": {"a": {"type": "string", "description": ""}}, "additionalProperties": False}}
    assert tools.slim(tool, 6) == {"name": "t", "description": "One.", "parameters": {"properties": {"a": {"type": "string"}}}}
    assert tools.slim_catalogue([tool])["tokens_after"] < tools.slim_catalogue([tool])["tokens_before"]
    with pytest.raises(TypeError):
        tools.dispatch("compress", {"text": 1})
    with pytest.raises(KeyError):
        tools.dispatch("none", {})
    rows = json.dumps([{"name": "long name of a thing", "k": i} for i in range(40)])
    assert tools.dispatch("auto", {"text": rows})["action"] == "compact" and tools.dispatch("inspect", {"text": rows})["format"] == "json"
    assert tools.facade({"tool": "search_tools", "query": "t"}, [tool], lambda q, ts: ts)["tools"][0]["name"] == "t"
    assert "error" in tools.facade({"tool": "call_tool", "name": "x"}, [tool], None)
    seen = tools.Interceptor(passthrough=("raw*",))
    out = seen.messages([{"role": "tool", "name": "db", "content": rows}, {"role": "tool", "name": "raw_db", "content": rows}, {"role": "user", "content": rows}, {"role": "tool", "name": "x", "content": [{"type": "text", "text": "short"}]}])
    assert out[0]["content"].startswith("@from") and out[1]["content"] == rows and (seen.compacted, seen.skipped) == (1, {"passthrough": 1, "short": 1})
    assert tools.opaque({"content": [{"type": "compaction"}]}) and tools.opaque({"content": '{"type":"compaction"}'}) and not tools.opaque({"content": "x"})
    assert tools.guaranteed(rows, lambda s: "x")[1] == "other" and tools.guaranteed(rows, lambda s: 1 / 0)[1] == "deterministic"
    assert next(iter(tools.layouts(rows))) in ("standard", "tokenizer")


def test_tokens(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    rows = spark.createDataFrame([("hello world", 1), ("", 2), (None, 3)], "t string, k int")
    assert [r.n for r in rows.select("k", tokens.counted(F.col("t")).alias("n")).orderBy("k").collect()] == [3, 1, None]
    if os.path.exists(path):
        assert [r.n for r in rows.select("k", tokens.counted(F.col("t"), path).alias("n")).orderBy("k").collect()] == [2, 0, None]
    tokens.register(lambda model: len if model == "letters" else None)
    assert tokens.resolve("letters")("abc") == 3 and tokens.resolve("other") is tokens.estimate
    tokens._factories.clear()
    coded = layers.compact(json.dumps([{"city": "San Francisco Bay"}] * 20)).text
    assert coded[: tokens.prefix_bytes(coded)].endswith("@end\n") and tokens.prefix_bytes("x") == 0
    got = rows.where("k = 1").select(tokens.cache_key(F.repeat("t", 1000)).alias("key"), tokens.cache_key("t").alias("none"), tokens.breakpoints(F.array(*map(F.lit, [1, 20000, 99999]))).alias("b"), tokens.passes(F.col("t"), ["hel*"]).alias("p"), tokens.clamp(F.col("t"), 5).alias("c"), tokens.cache_breakpoint(F.lit(coded), "long").alias("cb")).first()
    assert len(got.key) == 16 and got.none is None and got.b == [99999, 20000] and got.p and got.c == "world" and (got.cb.bytes, got.cb.seconds) == (tokens.prefix_bytes(coded), 3600)


def test_codecs_come_back(spark):
    rows = [(1, 1, -5, "~"), (1, 2, -5, "~"), (1, 3, -3, '"~'), (1, 4, None, None), (2, 1, 7, "b"), (2, 2, 7, "b"), (2, 3, 107, "b"), (2, 4, 207, "b")]
    df = spark.createDataFrame(rows, "g int, o int, n long, s string")
    back = deltas.decode_columns(deltas.encode_columns(df, ["n", "s"], ["g"], "o"), ["n", "s"], ["g"], "o")
    assert sorted((r.g, r.o, r.n, r.s) for r in back.collect()) == [(g, o, None if n is None else str(n), s) for g, o, n, s in rows]
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("o")
    coded = df.withColumn("c", deltas.exact(F.col("s"), w)).withColumn("i", deltas.numeric(F.col("n"), w))
    assert [r.s == r.b for r in coded.withColumn("b", deltas.exact_back(F.col("c"), w)).where("s is not null").collect()] == [True] * 7
    again = deltas.numeric_back(coded, "i", ["g"], "o", "back")
    assert all(r.n == r.back for r in again.collect())


def test_literal_aliases(spark):
    rows = spark.createDataFrame([(v,) for v in ["long brand name"] * 5 + ["$a", "$$a", "$zz", "x"]], "v string")
    d = text.dictionary(text.alias_candidates(rows, "v"))
    back = text.decode(text.encode(rows, "v", d, "c"), "c", d, "b").collect()
    assert d.count() == 1 and all(r.v == r.b for r in back) and sum(r.c == "$a" for r in back) == 5
    both = text.merged(spark.createDataFrame([("$a", "x"), ("$b", "y")], "alias string, value string"), d)
    assert {r.alias: r.value for r in both.collect()} == {"$a": "long brand name", "$b": "y"}


def test_prefixes_by_neighbours(spark):
    rng = random.Random(4)
    values = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
    df = spark.createDataFrame([(v,) for v in [*values, *values, None]], "v string")
    want = {}
    for u, v in zip(values, values[1:], strict=False):
        p = os.path.commonprefix([u, v])
        n = sum(x.startswith(p) and x != p for x in values)
        if len(p) >= 2 and n >= 3:
            want[p] = n
    assert {r.prefix: r.n for r in text.adjacent_prefixes(df, "v", 2).collect()} == want


def test_shared_lines_round_trip(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a shared line\n%x\n"), (1, 2, "user", "a shared line\n%%aa"), (2, 1, "user", "")], "conv_id int, turn int, role string, text string")
    lines = spark.createDataFrame([("a", "a shared line")], "alias string, line string")
    coded = engine.shared_rewrite(rows, lines)
    assert coded.where("conv_id = 1 and turn = 1").first().text == "%a\n%%x\n"
    assert sorted(r.text for r in engine.shared_restore(coded, lines).collect()) == sorted(r.text for r in rows.collect())


def test_packing(spark):
    items = spark.createDataFrame([("g", i, t, p) for i, (t, p) in enumerate([(30, 1), (60, 9), (50, 5), (10, 5), (200, 10)])], "g string, pos long, tokens long, priority long")
    kept = lambda s: {r.pos for r in engine.pack(items, "g", s, 150).where("kept").collect()}
    assert kept("priority") == {1, 3, 0} and kept("recency") == {3, 2, 0} and kept("balanced") == {1, 3, 0}
    s = engine.pack_stats(engine.pack(items, "g", "recency", 150), "g").first()
    assert (s.n_kept, s.n_dropped, s.used, s.total) == (3, 2, 90, 350)
    assert [r.tight for r in engine.pack(items, "g", "priority", 150).orderBy("place").collect()] == [False, False, False, True, True]


def test_context(spark):
    m = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", "x" * 400) for t in range(4)], "conv_id long, turn long, role string, text string")
    facts = spark.createDataFrame([(1, 0, "decision", "use B")], "conv_id long, turn long, category string, fact string")
    out = engine.optimised(m, facts, 500).orderBy("ord").collect()
    assert out[0].text == "# Index\n## decision\n- use B" and len(out) == 5 and out[2].text.startswith("[Same as turn 0: ")
    assert engine.optimised(m, facts, 5000).count() == 4
    right = spark.createDataFrame([("The Answer.", "the answer"), ("$1,000.02", "1000"), ("12", "13"), (None, "x")], "a string, b string").select(context.right_answer(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in right.collect()] == [True, True, False, False]


def test_cache_and_rolling_dictionary():
    cache = engine.TextCache(most_bytes=10, most=3)
    assert [cache.see(t) for t in ("aa", "bb", "aa", "cc", "dd", "bb", "aa")] == [False, False, True, False, False, False, False]
    assert cache.stats()["misses"] == 6 and engine.TextCache(most_bytes=3).see("long text") is False
    roll = engine.RollingDictionary()
    assert roll.seeds() == []
    roll.update({"a long value here": 3, "once": 1})
    roll.update({"secret": 9}, safe=False)
    assert roll.seeds() == ["a long value here"]
    roll.update({"a long value here": 2})
    assert roll.saved() == 5
    for _ in range(engine.IDLE_TURNS + 1):
        last = roll.seeds()
    assert last == []
    roll.update({f"value number {i}": 2 for i in range(150)})
    assert len(roll.entries) == engine.MOST_ROLLING


def test_streams(spark, tmp_path):
    from tamarack.streaming import first_texts, windowed_stats

    rows = [("s", 1, "x"), ("s", 2, "y"), ("s", 3, "x"), ("t", 1, "x")]
    df = spark.createDataFrame(rows, "session string, turn long, text string").withColumn("ts", F.timestamp_seconds(F.col("turn") * 10)).withColumn("format", F.col("text"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {}

    def run(name, query, mode):
        query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        got[name] = spark.table(name).collect()

    run("known", engine.seen_before(stream(), "session"), "append")
    assert sorted((r.session, r.turn, r.known) for r in got["known"]) == [("s", 1, False), ("s", 2, False), ("s", 3, True), ("t", 1, False)]
    run("firsts", first_texts(stream()), "append")
    assert sorted(r.text for r in got["firsts"]) == ["x", "y"]
    run("windows", windowed_stats(stream()), "update")
    assert sorted((r.format, r.calls) for r in got["windows"]) == [("x", 3), ("y", 1)]


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    rec = spark.createDataFrame([("r", "compress", "json", 100, 40, 1000), ("r", "boil", "json", 1, 1, 1000)], "t string, action string, format string, inputTokens long, outputTokens long, timestamp long")
    logs.append(rec, path)
    assert logs.lines(logs.folder(spark, path)).count() == 0  # Spark names its files .json
    raw = [("one", 1, '{"t":"h","sessionId":"s","agent":"a","project":"p","startedAt":5}'), ("one", 2, '{"t":"r","action":"compress","format":"json","inputTokens":10,"outputTokens":4,"timestamp":7,"durationMs":-1}'), ("one", 3, "broken"), ("two", 1, '{"t":"d","date":"2024-01-02","format":"csv","calls":5,"inputTokens":50}'), ("two", 2, '{"t":"x"}')]
    log = logs.lines(logs.by_line(spark.createDataFrame(raw, "file string, n long, text string"), "file", "n", "text"))
    got = {r.file: r for r in logs.records(log).collect()}
    assert got["one"].durationMs == 0 and got["two"].calls == 5
    assert logs.records(log, agent="other").count() == 1 and logs.records(log, since=10).count() == 1 and logs.records(log, active_only=True).count() == 1
    assert [r.sessionId for r in logs.active(log).collect()] == ["s"]
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.jsonl").write_text("\n".join(r[2] for r in raw[:3]))
    (files / "b.jsonl").write_text("{}" * 100)
    read = logs.lines(logs.folder(spark, str(files), largest=10))
    assert read.count() == 0 and logs.lines(logs.folder(spark, str(files))).count() == 2
    logs.reset(spark, path)
    assert spark.read.schema(logs.LINE).json(path).count() == 0
    assert logs.header(spark, "s", "a", "p", 1).count() == logs.footer(spark, "s", 2).count() == 1


def test_batch(spark):
    rows = spark.createDataFrame([(1, '{"a": [1, 2]}'), (2, None), (3, "prose")], "k int, t string")
    got = {r.k: (r.result, r.error) for r in engine.batch(rows, "t", 2).collect()}
    assert got[1][0].startswith("@from json") and got[2] == (None, None) and got[3] == ("prose", None)


def test_tail_and_family(spark):
    row = spark.range(1).select(lossy.tail_lines(F.lit("a\nb\nc"), 2).alias("t"), tokens.family(F.lit("gpt-4o-mini")).alias("f")).first()
    assert row.t == "b\nc" and row.f.family == "o200k_base"
