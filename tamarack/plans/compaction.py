"""Queries over the driver's tables for parsers, sinks, layers, logs, packing and streams, each with SQL for the same rows where SQL can say them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import code, detect, documents, formats, layers, tokens, tools
from tamarack.operators import context, deltas, engine, text
from tamarack.plans.catalogue import query
from tamarack.sources import logs, table
from tamarack.streaming import running_stats

#: Records of one text.
CHUNK = 50
ROWS = "array<struct<k:long,name:string,segment:string,open:boolean>>"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """``chunk, rows``: customers as texts of CHUNK records."""
    row = F.struct(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 3 == 0).alias("open"))
    c = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / CHUNK).cast("long").alias("chunk"), row.alias("r"))
    return c.groupBy("chunk").agg(F.array_sort(F.collect_list("r")).alias("rows"))


def _rows(df: DataFrame, value: Column) -> DataFrame:
    return df.select("chunk", F.explode(F.from_json(value, ROWS)).alias("r")).select("chunk", "r.*")


_CUSTOMERS = f"select cast(floor(c_custkey / {CHUNK}.0) as bigint) as chunk, c_custkey as k, c_name as name, c_mktsegment as segment, c_custkey % 3 = 0 as open from customer"


def _compacted(text_: Column, *wanted: int) -> Column:
    return formats.mapped(lambda s: layers.compact(s, wanted).text)(text_)


@query(_CUSTOMERS)
def compact_roundtrip(spark, d):
    """Records through structure, dictionary and line forms, and back."""
    coded = _chunks(spark, d).select("chunk", _compacted(F.to_json("rows"), 1, 2, 3).alias("text"))
    return _rows(coded.where(F.col("text").startswith("@from")), formats.mapped(layers.expanded)("text"))


def _csv(rows: str | Column) -> Column:
    line = lambda r: F.concat_ws(",", r["k"].cast("string"), r["name"], r["segment"], r["open"].cast("string"))
    return F.concat(F.lit("k,name,segment,open\n"), F.array_join(F.transform(rows, line), "\n"))


@query(_CUSTOMERS)
def csv_parse(spark, d):
    return _rows(_chunks(spark, d), formats.parsed(_csv("rows"), "csv"))


@query(_CUSTOMERS)
def yaml_roundtrip(spark, d):
    return _rows(_chunks(spark, d), formats.parsed(formats.written(F.to_json("rows"), "yaml"), "yaml"))


@query(_CUSTOMERS)
def jsonc_parse(spark, d):
    """Records with comments between them."""
    commented = F.concat(F.lit("// records\n["), F.array_join(F.transform("rows", lambda r: F.to_json(r)), ", /* next */\n"), F.lit("] // end"))
    return _rows(_chunks(spark, d), formats.parsed(commented, "json"))


_SQL_CHUNKS = f"select cast(floor(c_custkey / {CHUNK}.0) as bigint) as chunk, "


@query(_SQL_CHUNKS + """md5('k,name,segment,open' || chr(13) || chr(10) || string_agg(c_custkey || ',' || c_name || ',' || c_mktsegment || ',' || (c_custkey % 3 = 0)::varchar, chr(13) || chr(10) order by c_custkey)) as digest from customer group by 1""")
def csv_sink(spark, d):
    return _chunks(spark, d).select("chunk", F.md5(formats.written(F.to_json("rows"), "csv")).alias("digest"))


@query(_SQL_CHUNKS + """md5('| k | name | segment | open |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' | ' || (c_custkey % 3 = 0)::varchar || ' |', chr(10) order by c_custkey)) as digest from customer group by 1""")
def markdown_sink(spark, d):
    return _chunks(spark, d).select("chunk", F.md5(formats.written(F.to_json("rows"), "markdown")).alias("digest"))


@query(_SQL_CHUNKS + """md5(string_agg('- k: ' || c_custkey || chr(10) || '  name: ' || c_name || chr(10) || '  segment: ' || c_mktsegment || chr(10) || '  open: ' || (c_custkey % 3 = 0)::varchar, chr(10) order by c_custkey)) as digest from customer group by 1""")
def text_sink(spark, d):
    return _chunks(spark, d).select("chunk", F.md5(formats.written(F.to_json("rows"), "text")).alias("digest"))


@query(f"""with c as (select count(distinct floor(c_custkey / {CHUNK}.0)) as n from customer)
select form, form as detected, n from c, (values ('json'), ('csv'), ('yaml'), ('markdown'), ('compact'), ('text')) f(form)""")
def format_routing(spark, d):
    """Texts of each format, and what they are taken for."""
    j = F.to_json("rows")
    every = {"json": j, "csv": _csv("rows"), "yaml": formats.written(j, "yaml"), "markdown": formats.written(j, "markdown"), "compact": _compacted(j, 1), "text": F.concat_ws(" ", F.lit("Customers of chunk"), F.col("chunk").cast("string"))}
    forms = F.array(*[F.struct(F.lit(k).alias("form"), v.alias("text")) for k, v in every.items()])
    one = _chunks(spark, d).select(F.explode(forms).alias("f")).select("f.form", detect.detected(F.col("f.text"))["format"].alias("detected"))
    return one.groupBy("form", "detected").agg(F.count(F.lit(1)).alias("n"))


@query("""select conv_id, turn, md5(text) as digest from conversations where text is not null""")
def text_layer_roundtrip(spark, d):
    """Repeated lines and phrases of each turn, twice over, as references, and back."""
    rows = table(spark, d, "conversations").where("text is not null")
    back = formats.mapped(lambda s: layers.expand_text(layers.compact_text(s + "\n" + s)))
    return rows.withColumn("b", back("text")).select("conv_id", "turn", F.md5(F.expr("substring(b, 1, length(text))")).alias("digest"))


@query("select doc_id, md5(coalesce(text, '')) as digest from documents")
def line_runs_roundtrip(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.md5(text.expanded_runs(text.collapsed_runs(F.col("text")))).alias("digest"))


@query("""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
select doc_id, md5(array_to_string(list_transform(l, lambda x, i: case when length(x) >= 10 and list_position(l, x) < i then '@L' || (list_position(l, x) - 1)
  when starts_with(x, '@') then '@' || x else x end), chr(10))) as digest from l""")
def line_references(spark, d):
    return text.referenced_lines(table(spark, d, "documents")).select("doc_id", F.md5("text").alias("digest"))


@query("""select user_id, event_id, event_id % 7 - 3 as small, case when event_id % 2 = 0 then '~' else event_type end as kind, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events where user_id is not null""")
def delta_columns_roundtrip(spark, d):
    """Negative numbers, literal marks and times by user, coded where that pays, and back."""
    e = table(spark, d, "events").where("user_id is not null")
    kind = F.when(F.col("event_id") % 2 == 0, "~").otherwise(F.col("event_type"))
    e = e.select("user_id", "event_id", (F.col("event_id") % 7 - 3).alias("small"), kind.alias("kind"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    cols = ["small", "kind", "at"]
    back = deltas.decode_columns(deltas.encode_columns(e, cols, ["user_id"], "event_id"), cols, ["user_id"], "event_id")
    return back.withColumn("small", F.col("small").cast("long"))


_LOG = """with e as (select coalesce(cast(user_id as varchar), 'none') as file, event_id, event_type as format, event_id % 1000 + 100 as i, event_id % 700 + 50 as o, epoch_ms(ts) as ms from events),
s as (select file, min(ms) as started, count(*) as n, max(event_id) % 2 = 0 as closed, case when max(event_id) % 3 = 0 then 'even' else 'odd' end as project from e group by file) """


def _log(spark: SparkSession, d: str) -> DataFrame:
    """The event table as lines of session logs, one file a user, and a line that doesn't parse in each."""
    e = table(spark, d, "events").select(F.coalesce(F.col("user_id").cast("string"), F.lit("none")).alias("file"), "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    rec = F.to_json(F.struct(F.lit("r").alias("t"), F.lit("compress").alias("action"), F.col("event_type").alias("format"), (F.col("event_id") % 1000 + 100).alias("inputTokens"), (F.col("event_id") % 700 + 50).alias("outputTokens"), F.col("at").alias("timestamp")))
    per = e.groupBy("file").agg(F.min("at").alias("at"), F.max("event_id").alias("m"))
    head = F.to_json(F.struct(F.lit("h").alias("t"), F.col("file").alias("sessionId"), F.lit("cli").alias("agent"), F.when(F.col("m") % 3 == 0, "even").otherwise("odd").alias("project"), F.col("at").alias("startedAt")))
    foot = F.to_json(F.struct(F.lit("f").alias("t"), F.col("file").alias("sessionId"), F.col("at").alias("endedAt")))
    rows = e.select("file", F.col("event_id").alias("line_no"), rec.alias("line"))
    rows = rows.unionByName(per.select("file", F.lit(-2).cast("long").alias("line_no"), head.alias("line")))
    rows = rows.unionByName(per.select("file", F.lit(-1).cast("long").alias("line_no"), F.lit('{"t": broken').alias("line")))
    return logs.lines(rows.unionByName(per.where("m % 2 = 0").select("file", F.lit(1 << 60).alias("line_no"), foot.alias("line"))))


@query(_LOG + "select file, project, n as records, closed from s")
def log_sessions(spark, d):
    return logs.sessions(_log(spark, d)).select("file", "project", "records", "closed")


@query(_LOG + "select count(*) as n, cast(sum(n) as bigint) as records from s where not closed")
def log_active_sessions(spark, d):
    return logs.active(_log(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.sum("records").alias("records"))


@query(_LOG + "select coalesce(project, 'all') as project, count(*) as calls, cast(sum(i) as bigint) as input, cast(sum(o) as bigint) as output from e join s using (file) group by rollup (project)")
def log_project_stats(spark, d):
    return logs.project_stats(_log(spark, d)).withColumn("project", F.coalesce("project", F.lit("all")))


@query(_LOG + """, n as (select max(ms) - 10 * 86400000 as cut from e)
select cast(make_timestamp(ms * 1000)::date as varchar) as date, format, count(*) as calls, cast(sum(i) as bigint) as input from e join s using (file), n where closed and started < cut group by 1, 2""")
def log_compaction(spark, d):
    """Closed sessions begun over ten days before the log's last record become sums by day."""
    log = _log(spark, d)
    now = log.agg(F.max("timestamp")).first()[0]
    sums, _ = logs.compacted(log, now, days=10)
    return sums.select("date", "format", "calls", F.col("inputTokens").alias("input"))


@query(_LOG + "select format, count(*) as calls, cast(sum(i - o) as bigint) as saved_tokens from e group by format")
def stream_running_stats(spark, d):
    """The log as a stream, run until its input is used up; the last complete result."""
    path = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/[e]vents.parquet")
    calls = events.select(F.col("event_type").alias("format"), (F.col("event_id") % 1000 + 100).alias("input_tokens"), (F.col("event_id") % 700 + 50).alias("output_tokens"))
    out = []

    def keep(batch: DataFrame, _: int) -> None:
        out[:] = [tuple(r) for r in batch.collect()]  # one row a format

    running_stats(calls).writeStream.outputMode("complete").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.createDataFrame(out, "format string, calls long, saved_tokens long")


_ITEMS = """with recursive m as (select conv_id, turn, greatest(1, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint)) as tokens, turn % 5 as priority from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by {order}, turn) - 1 as place from m),
r as (select conv_id, place, turn, tokens, tokens <= {budget} as kept, case when tokens <= {budget} then tokens else 0 end as used from o where place = 0
  union all select o.conv_id, o.place, o.turn, o.tokens, r.used + o.tokens <= {budget}, r.used + case when r.used + o.tokens <= {budget} then o.tokens else 0 end from r join o on o.conv_id = r.conv_id and o.place = r.place + 1)
select conv_id, turn, place, kept from r"""


def _items(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    m = table(spark, d, "conversations").where("conv_id is not null")
    size = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)).cast("long")
    out = engine.pack(m.select("conv_id", "turn", size.alias("tokens"), (F.col("turn") % 5).alias("priority")), "conv_id", strategy, 150, pos="turn")
    return out.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "kept")


@query(_ITEMS.format(order="turn desc", budget=100))
def pack_items_recency(spark, d):
    return _items(spark, d, "recency")


@query(_ITEMS.format(order="priority desc", budget=100))
def pack_items_priority(spark, d):
    return _items(spark, d, "priority")


@query("""with m as (select conv_id, turn, coalesce(text, '') as text from conversations union all select conv_id, turn + 1000, coalesce(text, '') from conversations),
f as (select *, min(turn) over (partition by conv_id, substr(text, 1, 200), length(text)) as first from m)
select conv_id, turn, md5(case when turn > first and text <> '' then '[Same as turn ' || first || ': ' || substr(text, 1, 60) || '...]' else text end) as digest from f""")
def repeated_turns(spark, d):
    """Conversations told twice: the second time each turn is a remark."""
    m = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    return engine.deduplicated(m.unionByName(m.withColumn("turn", F.col("turn") + 1000))).select("conv_id", "turn", F.md5("text").alias("digest"))


@query("""select doc_id % 7 as kind, 1 as start, cast(doc_id % 7 - 1 as bigint) as n, count(*) as texts from documents where doc_id % 7 >= 3 group by 1, 2, 3""")
def blank_runs_made(spark, d):
    """Runs of up to five blank lines between two words."""
    made = table(spark, d, "documents").select("doc_id", F.concat(F.lit("a"), F.repeat(F.lit("\n"), (F.col("doc_id") % 7).cast("int")), F.lit("b")).alias("text"))
    runs = text.blank_runs(made)
    return runs.groupBy((F.col("id") % 7).alias("kind"), "start", "n").agg(F.count(F.lit(1)).alias("texts"))


@query("""select conv_id, '# Index' || chr(10) || '## decision' || chr(10) || '- use plan ' || conv_id || chr(10) || '- use plan B' || chr(10) || '## preference' || chr(10) || '- short texts' as text
from (select distinct conv_id from conversations where conv_id is not null)""")
def fact_index(spark, d):
    """Facts of each conversation, one of them told twice, as its index."""
    ids = table(spark, d, "conversations").where("conv_id is not null").select("conv_id").distinct()
    told = [(1, "decision", F.concat(F.lit("use plan "), F.col("conv_id").cast("string"))), (2, "preference", F.lit("short texts")), (3, "decision", F.lit("use plan B")), (4, "decision", F.lit("use plan B"))]
    facts = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(c).alias("category"), f.alias("fact")) for t, c, f in told])).alias("f")
    return engine.index_messages(ids.select("conv_id", facts).select("conv_id", "f.*"))


@query(f"""with c as (select count(distinct floor(c_custkey / {CHUNK}.0)) as n from customer) select code, n as texts from c, (values ('E001'), ('E003'), ('E007'), ('W003')) f(code)""")
def validate_faults(spark, d):
    """Four faults put into each compact text, and the codes that the check finds."""
    fault = F.concat(F.lit("@dict\n  $a: x\nk: $a \nlist [3]: 1,2"))
    codes = formats.mapped(lambda s: sorted({x["code"] for x in documents.validate(s)}), schema="array<string>")
    return _chunks(spark, d).select(F.explode(codes(F.concat(F.lit(""), fault, F.expr("concat('\\nid: ', chunk)")))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("texts"))


@query(_CUSTOMERS)
def model_output(spark, d):
    """Compact texts with a wrong count, fenced in an answer, mended and read."""
    coded = F.regexp_replace(_compacted(F.to_json("rows"), 1, 2), r"_root \[\d+\]", "_root [999]")
    answer = F.concat(F.lit("Here you are:\n```\n"), coded, F.lit("\n```\nAnything else?"))
    read = formats.mapped(lambda s: documents.interpret(s)["value"])
    return _rows(_chunks(spark, d), read(answer))


@query(_CUSTOMERS)
def mixed_roundtrip(spark, d):
    """Records fenced in prose: only they are compacted, and come back."""
    page = F.concat(F.lit("# Report\n\nSome prose.\n```json\n"), F.to_json("rows"), F.lit("\n```\nThe end."))
    both = _chunks(spark, d).select("chunk", formats.mapped(documents.compact_mixed)(page).alias("text")).where(F.col("text").contains("<!-- compact:json -->") & F.col("text").startswith("# Report\n\nSome prose.\n"))
    back = both.select("chunk", formats.mapped(documents.expand_mixed)("text").alias("text"))
    return _rows(back, F.regexp_extract("text", r"(?s)```json\n(.*)\n```", 1))


@query("""select p_partkey, '{"name":"tool_' || p_partkey || '","description":"' || p_name || '","parameters":{"properties":{"n":{"type":"integer"}}}}' as slim from part""")
def tool_slim(spark, d):
    tool = F.concat(F.lit('{"name":"tool_'), F.col("p_partkey").cast("string"), F.lit('","description":"'), "p_name", F.lit('","title":null,"tags":[],"parameters":{"type":"object","properties":{"n":{"type":"integer","description":""}},"additionalProperties":false}}'))
    slim = formats.mapped(lambda s: json.dumps(tools.slim(json.loads(s)), ensure_ascii=False, separators=(",", ":")))
    return table(spark, d, "part").select("p_partkey", slim(tool).alias("slim"))


@query("""select o_orderkey, o_orderkey % 10 as saved, case when o_orderkey % 50 + 10 > 0 then cast(floor(100.0 * (o_orderkey % 10) / (o_orderkey % 50 + 10) + 0.5) as bigint) else 0 end as percent from orders""")
def token_savings(spark, d):
    o = table(spark, d, "orders")
    before = F.col("o_orderkey") % 50 + 10
    s = tokens.savings(before, before - F.col("o_orderkey") % 10, F.lit(2.5), F.lit(10.0))
    return o.select("o_orderkey", s["saved"].alias("saved"), s["percent"].alias("percent"))


@query("""select o_custkey, o_orderstatus as status, cast(o_orderkey % 9 as bigint) as attempts from orders where o_orderkey % 100 = 7""")
def nested_lookup(spark, d):
    """A nested path of each matching record, and a lookup by a field that is no key."""
    made = F.to_json(F.struct(F.struct(F.struct(F.col("o_custkey").alias("id"), F.struct((F.col("o_orderkey") % 9).alias("max_attempts")).alias("retries")).alias("billing")).alias("services"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 100).alias("rest")))
    v = F.parse_json(made)
    at = lambda path, kind: F.variant_get(v, path, kind)
    found = table(spark, d, "orders").where(at("$.rest", "long") == 7)
    return found.select(at("$.services.billing.id", "long").alias("o_custkey"), at("$.status", "string").alias("status"), at("$.services.billing.retries.max_attempts", "long").alias("attempts"))


@query("""select o_orderkey, cast(o_custkey + o_orderkey % 7 + o_orderkey % 5 as bigint) as total, array_to_string(list_sort(list_filter(['a', 'b', 'c'], lambda k: case k when 'a' then o_custkey when 'b' then o_orderkey % 7 else o_orderkey % 5 end > 2)), ',') as over_two from orders""")
def map_values(spark, d):
    """The sum over a map's values, and its keys whose value passes a test."""
    m = F.create_map(F.lit("a"), F.col("o_custkey").cast("long"), F.lit("b"), (F.col("o_orderkey") % 7).cast("long"), F.lit("c"), (F.col("o_orderkey") % 5).cast("long"))
    total = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + x)
    keys = F.array_join(F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: v > 2))), ",")
    return table(spark, d, "orders").select("o_orderkey", total.alias("total"), keys.alias("over_two"))


@query("""with n as (select o_orderpriority, count(*) as n, min(o_orderkey) as first from orders group by 1) select o_orderpriority, n from n order by n desc, first limit 1""")
def group_count_top1(spark, d):
    """The group of most rows, the first met among equals."""
    per = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    return per.orderBy(F.desc("n"), "first").limit(1).select("o_orderpriority", "n")


@query("""select c_mktsegment, floor(avg(cast(c_acctbal as decimal(18, 2))) * 10 + 0.5) / 10 as mean from customer group by 1""")
def avg_one_decimal(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg((F.floor(F.avg(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") * 10 + 0.5) / 10).alias("mean"))


@query("""select o_orderkey, o_orderkey % 4 <> 3 as correct from orders""")
def answer_scoring(spark, d):
    """Answers that are right in words, within the tolerance, as a number with its unit, or wrong."""
    k, want = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("double")
    said = F.when(k == 0, F.format_number(want, 2)).when(k == 1, F.concat(F.lit("  "), F.round(want + 0.01, 2).cast("decimal(18,2)").cast("string"), F.lit(" "))).when(k == 2, F.concat(F.lit("$"), want.cast("decimal(18,2)").cast("string"))).otherwise((want + 10).cast("decimal(18,2)").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", context.right_answer(said, want.cast("decimal(18,2)").cast("string")).alias("correct"))


@query()
def token_counts(spark, d):
    """Tokens of each turn by the estimate, or by the vocabulary that the session's ``tamarack.vocabulary`` names."""
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", tokens.counted(F.col("text"), spark.conf.get("tamarack.vocabulary", None)).alias("tokens"))


@query()
def compressibility(spark, d):
    kind = "score double, repetition double, structure double, schema double, length double, label string, profile string"
    return _chunks(spark, d).select("chunk", formats.mapped(documents.score, schema=kind)(F.to_json("rows")).alias("s")).select("chunk", "s.*")


@query()
def layer_savings(spark, d):
    """Tokens by layer profile of each text."""
    def one(s: str) -> dict:
        return {p: layers.compact(s, ls).tokens_after for p, ls in layers.PROFILES.items()} | {"original": tokens.estimate(s)}

    kind = "original long, structure long, standard long, tokenizer long, semantic long"
    return _chunks(spark, d).select("chunk", formats.mapped(one, schema=kind)(F.to_json("rows")).alias("s")).select("chunk", "s.*")


@query()
def rolling_dictionary(spark, d):
    """Texts of a session, each of CHUNK records, through one dictionary."""
    rows = _chunks(spark, d).select((F.col("chunk") % 8).alias("session"), F.col("chunk").alias("turn"), F.to_json("rows").alias("text"))
    return engine.rolled(rows, "session")


@query("select 8 as texts, true as same, cast(8 as bigint) as bare")
def code_compaction(spark, d):
    """Two programs, with and without comments, told by line: what is left of either form agrees."""
    python = 'import os\n\n\n\ndef f(x):{c}\n    """doc # kept"""\n    return x + "# kept"  \n'
    c_like = 'function f() {{{c}\n  const u = "http://kept"; \n  return u;\n}}\n'
    rows = [(k, (python if k % 2 else c_like).format(c=""), (python if k % 2 else c_like).format(c="  # gone" if k % 2 else "  // gone /* too")) for k in range(8)]
    df = spark.createDataFrame(rows, "k long, plain string, noted string")
    bare = formats.mapped(code.compact_code)
    both = df.select(bare("plain").alias("a"), bare("noted").alias("b"))
    return both.agg(F.count(F.lit(1)).cast("int").alias("texts"), F.bool_and(F.col("a") == F.col("b")).alias("same"), F.count_if(~F.col("b").contains("gone") & F.col("b").contains("kept")).alias("bare"))
