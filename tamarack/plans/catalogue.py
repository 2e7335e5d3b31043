"""Queries by name over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack import functions as fn
from tamarack.functions import codec, lossy, privacy, texts
from tamarack.operators import context, deltas, evaluation, search, stats, text
from tamarack.sources import events_as_calls, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return events_as_calls(table(spark, d, "events"))


_CALLS = """with calls as (select case when event_id % 4 = 0 then 'decompress' else 'compress' end as action, event_type as format,
  event_id % 1000 + 100 as input_tokens, event_id % 700 + 50 as output_tokens, event_id % 5 <> 0 as reversible, user_id, ts, value as duration_ms from events) """


@query(_CALLS + """select format, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens,
  cast(sum(input_tokens - output_tokens) as bigint) as saved_tokens, count(*) filter (not reversible) as lossy_calls,
  cast(floor(avg(cast(duration_ms as decimal(18, 4))) + 0.5) as bigint) as avg_ms from calls group by format""")
def session_stats_by_type(spark, d):
    return stats.session_stats(_calls(spark, d))


@query(_CALLS + "select format, quantile_disc(duration_ms, 0.5) as p50, quantile_disc(duration_ms, 0.95) as p95, quantile_disc(duration_ms, 0.99) as p99 from calls group by format")
def latency_percentiles(spark, d):
    return stats.latency_percentiles(_calls(spark, d))


@query(_CALLS + """, l as (select max(cast(ts as date)) as l from calls), days as (select cast(l - cast(i as integer) as date) as day from l, range(7) r(i))
select cast(days.day as varchar) as day, count(calls.ts) as calls, cast(coalesce(sum(input_tokens - output_tokens), 0) as bigint) as saved
from days left join calls on cast(ts as date) = days.day group by 1""")
def telemetry_daily_zero_filled(spark, d):
    return stats.daily_zero_filled(_calls(spark, d))


@query(_CALLS + "select format, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from calls group by format")
def archive_compaction(spark, d):
    return stats.from_archive(stats.archive(_calls(spark, d)))


@query(_CALLS + "select format, count(*) as calls from calls group by format order by calls desc, format limit 1")
def top_type(spark, d):
    return stats.top_format(_calls(spark, d))


@query(_CALLS + """select action, count(*) filter (input_tokens > output_tokens) as saved_calls, count(*) filter (input_tokens <= output_tokens) as skipped_calls,
  cast(sum(greatest(input_tokens - output_tokens, 0)) as bigint) as saved_tokens from calls group by action""")
def calls_saved_vs_skipped(spark, d):
    return stats.savings_report(_calls(spark, d))


@query("select event_id, event_type from events order by ts desc, event_id desc limit 100")
def history_retention_top100(spark, d):
    return stats.latest(table(spark, d, "events").select("event_id", "event_type", "ts"), "ts", "event_id").select("event_id", "event_type")


@query(_CALLS + """select model, cast(floor(saved * usd + 0.5) as bigint) as micro_usd from (select sum(input_tokens - output_tokens) as saved from calls),
  (values ('claude-sonnet', 3.0::double), ('claude-opus', 15.0), ('claude-haiku', 0.8), ('gpt-4o', 2.5), ('gpt-4o-mini', 0.15)) p(model, usd)""")
def cost_saved(spark, d):
    return stats.cost_saved(_calls(spark, d))


@query("""select coalesce(user_id, -1) as user_id, event_type, grouping(user_id) as all_users, count(*) as calls from events group by grouping sets ((user_id, event_type), (event_type))""")
def lifetime_rollup(spark, d):
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    both = per.select("user_id", "event_type", F.lit(0).cast("long").alias("all_users"), F.col("n").alias("calls"))
    return both.unionByName(per.groupBy("event_type").agg(F.sum("n").alias("calls")).select(F.lit(-1).cast("long").alias("user_id"), "event_type", F.lit(1).cast("long").alias("all_users"), "calls"))


@query("select c_custkey, c_name, c_mktsegment from customer where c_custkey = 42")
def user_lookup(spark, d):
    return table(spark, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment")


@query("select c_mktsegment, count(*) filter (c_acctbal > 9000) > 0 as has_over from customer group by 1")
def exists_over(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg((F.count_if(F.col("c_acctbal") > 9000) > 0).alias("has_over"))


@query("select count(*) as n from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def filtered_count(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 1")
def argmax_value(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


@query("select l_returnflag, cast(floor(avg(cast(l_quantity as decimal(18, 2))) + 0.5) as bigint) as avg_qty from lineitem group by 1")
def avg_rounded(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(fn.half_up(F.avg(F.col("l_quantity").cast("decimal(18,2)"))).alias("avg_qty"))


@query("""select o_orderpriority, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) = 1""")
def group_top1(spark, d):
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(best.alias("b")).select("o_orderpriority", "b.o_orderkey", "b.o_totalprice")


@query("""select lang, count(*) filter (quality = 1 and toxic = 1) as both, count(*) filter (quality = 1 and toxic = 0) as only_first,
  count(*) filter (quality = 0 and toxic = 1) as only_second, count(*) filter (quality = 0 and toxic = 0) as neither from labels join documents using (doc_id) group by lang""")
def matched_pairs(spark, d):
    pairs = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    n = lambda q, t, name: F.count_if((F.col("quality") == q) & (F.col("toxic") == t)).alias(name)
    return pairs.groupBy("lang").agg(n(1, 1, "both"), n(1, 0, "only_first"), n(0, 1, "only_second"), n(0, 0, "neither"))


@query("select lang, cast(sum(greatest(1, cast(ceil(length(text) / 4.0) as bigint))) as bigint) as tokens, count(*) as docs from documents group by lang")
def doc_token_estimate_by_lang(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(fn.estimate_tokens(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("docs"))


@query(r"""select doc_id, cast(round(case when length(text) = 0 then 0 else len(regexp_extract_all(substring(text, 1, 32768), '[{}\[\]",:\n\r\t ]')) / least(length(text), 32768)::double end * 10000) as bigint) as overhead from documents""")
def doc_structural_overhead(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(fn.structural_overhead(F.col("text")) * 10000).cast("long").alias("overhead"))


@query("""select doc_id, cast(round((1 - len(list_distinct(w)) / len(w)::double) * 10000) as bigint) as density from (select doc_id, string_split(text, ' ') as w from documents)""")
def doc_repetition_density(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(fn.repetition_density(F.split("text", " ")) * 10000).cast("long").alias("density"))


@query("""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents), g as (select doc_id, line, count(*) as n from l group by all)
select doc_id as id, cast(sum(n) as bigint) as n_lines, cast(sum(case when length(line) >= 10 then n - 1 else 0 end) as bigint) as n_repeats from g group by 1""")
def doc_line_dedup(spark, d):
    return text.first_lines(table(spark, d, "documents"))


@query("""with l as (select doc_id as id, z[1] as line, cast(z[2] as bigint) as pos from (select doc_id, unnest(list_zip(string_split(coalesce(text, ''), chr(10)), list_transform(range(len(string_split(coalesce(text, ''), chr(10)))), lambda i: cast(i as varchar)))) as z from documents)),
s as (select id, pos, coalesce(line = lag(line) over (partition by id order by pos), false) as same from l),
t as (select id, same, coalesce(lead(same) over (partition by id order by pos), false) and not same as starts from s)
select id, count(*) filter (starts) as n_runs, count(*) filter (same) as n_collapsed from t group by id""")
def doc_line_rle(spark, d):
    return text.line_runs(table(spark, d, "documents"))


@query("""with l as (select unnest(string_split(coalesce(text, ''), chr(10))) as line from conversations), c as (select line, count(*) as n, greatest(1, cast(ceil(length(line) / 4.0) as bigint)) as tokens from l group by line)
select line, n, tokens, (tokens - 1) * n - (tokens + 3) as net from c where n >= 2 and tokens >= 4 and (tokens - 1) * n - (tokens + 3) > 0 order by net desc, n desc, line limit 64""")
def shared_lines(spark, d):
    return text.shared_lines(table(spark, d, "conversations"))


@query(r"""with w as (select list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '') as w from conversations),
g as (select unnest(list_transform(range(1, greatest(len(w) - 2, 0)), lambda i: array_to_string(w[i:i+3], ' '))) as phrase from w), c as (select phrase, count(*) as n, greatest(1, cast(ceil(length(phrase) / 4.0) as bigint)) as tokens from g group by phrase)
select phrase, n, tokens, (tokens - 1) * n - (tokens + 3) as net from c where n >= 2 and (tokens - 1) * n - (tokens + 3) > 0""")
def ngram_candidates(spark, d):
    return text.phrase_candidates(table(spark, d, "conversations"), 4)


@query(r"""with w as (select list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '') as w from documents),
g as (select unnest(list_transform(range(1, greatest(len(w) - k + 1, 0) + 1), lambda i: array_to_string(w[i:i+k-1], ' '))) as phrase from w, range(2, 9) z(k)),
c as (select phrase, count(*) as n, greatest(1, cast(ceil(length(phrase) / 4.0) as bigint)) as tokens from g group by phrase)
select phrase, n, tokens, (tokens - 1) * n - (tokens + 3) as net from c where n >= 2 and (tokens - 1) * n - (tokens + 3) > 0""")
def ngram_candidates_documents(spark, d):
    """All sizes of the reference over documents; ngram_candidates is the part of four words over conversations."""
    return text.phrase_candidates(table(spark, d, "documents").select("text"), range(2, 9))


@query("""with c as (select p_type as value, count(*) as n, greatest(1, cast(ceil(length(p_type) / 4.0) as bigint)) as tokens from part group by 1) select value, n, tokens, (tokens - 1) * n - (tokens + 3) as net from c where n >= 3 and (tokens - 1) * n - (tokens + 3) > 0""")
def exact_alias_candidates(spark, d):
    return text.alias_candidates(table(spark, d, "part"), "p_type")


@query("select p_brand, count(*) as n, count(*) as n_back from part group by 1")
def dictionary_roundtrip(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    words = text.dictionary(text.alias_candidates(part, "p_brand"))
    back = text.decode(text.encode(part, "p_brand", words, "cell"), "cell", words, "again")
    return back.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("again") == F.col("p_brand")).alias("n_back"))


@query("""with v as (select distinct c_name as v from customer where c_name is not null), p as (select v, lag(v) over (partition by v[1:8] order by v) as u from v),
x as (select distinct v[1:n] as prefix from (select v, u, (select max(i) from range(0, length(v) + 1) r(i) where v[1:i] = u[1:i] and i <= length(u)) as n from p where u is not null) where n >= 8)
select prefix, count(*) as n from x join v on starts_with(v.v, x.prefix) and v.v <> x.prefix group by prefix having count(*) >= 3""")
def prefix_candidates(spark, d):
    return text.adjacent_prefixes(table(spark, d, "customer"), "c_name")


_ORDER = ["o_custkey"]


@query("""select o_orderkey, case when row_number() over w > 1 and o_orderstatus is not distinct from lag(o_orderstatus) over w then '~' else o_orderstatus end as cell, o_orderstatus as again
from orders window w as (partition by o_custkey order by o_orderkey)""")
def delta_exact(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    coded = table(spark, d, "orders").select("o_custkey", "o_orderkey", deltas.exact(F.col("o_orderstatus"), w).alias("cell"))
    return coded.select("o_orderkey", "cell", deltas.exact_back(F.col("cell"), w).alias("again"))


@query("""with x as (select o_orderkey, o_custkey, cast(floor(o_totalprice) as bigint) as v from orders), y as (select *, v - lag(v) over (partition by o_custkey order by o_orderkey) as dv from x)
select o_orderkey, case when dv is null or dv = 0 then cast(v as varchar) when dv > 0 then '+' || dv else cast(dv as varchar) end as cell, v as again from y""")
def delta_numeric(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("v"))
    coded = rows.select("o_custkey", "o_orderkey", deltas.numeric(F.col("v"), w).alias("cell"))
    return deltas.numeric_back(coded, "cell", _ORDER, "o_orderkey", "again").select("o_orderkey", "cell", "again")


@query("""with x as (select l_orderkey, l_linenumber, l_partkey, l_returnflag is not distinct from lag(l_returnflag) over w and row_number() over w > 1 as a, l_linestatus is not distinct from lag(l_linestatus) over w and row_number() over w > 1 as b
from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag, l_linestatus)) select l_orderkey, count(*) as n_rows, cast(sum(a::int + b::int) as bigint) as repeats from x group by 1""")
def delta_repeat_ratio(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus").alias("at"), "l_returnflag", "l_linestatus")
    return deltas.repeat_ratio(rows, ["l_returnflag", "l_linestatus"], ["l_orderkey"], "at")


@query("""with x as (select user_id, epoch(date_trunc('second', ts))::bigint as v, event_id from events), y as (select user_id, v, v - lag(v) over (partition by user_id order by event_id) as dv from x)
select user_id, count(*) as n_rows, cast(sum(length(cast(v as varchar))) as bigint) as plain, cast(sum(length(case when dv is null or dv = 0 then cast(v as varchar) when dv > 0 then '+' || dv else cast(dv as varchar) end)) as bigint) as coded from y group by 1""")
def delta_temporal_savings(spark, d):
    """The numeric codec on unix seconds; delta_temporal_iso_savings is the temporal codec on ISO text."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("v"))
    return deltas.savings(rows, "v", ["user_id"], "event_id")


_ISO_GROUPS = """with x as (select user_id, event_id, epoch(date_trunc('second', ts))::bigint as v, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso from events),
y as (select *, v - lag(v) over (partition by user_id order by event_id) as dv from x),
g as (select user_id, count(*) as n_rows, cast(sum(length(iso)) as bigint) as plain, cast(sum(case when dv is null then length(iso) when dv = 0 then 1 else 2 + length(cast(abs(dv) as varchar)) end) as bigint) as coded, coalesce(max(abs(dv)) > 0, false) as moves from y group by 1),
p as (select user_id, n_rows, plain, coded, moves and n_rows >= 3 and 5 * (plain - coded) >= plain as pays from g) """


def _iso_events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query(_ISO_GROUPS + "select * from p")
def delta_temporal_iso_savings(spark, d):
    return deltas.temporal_savings(_iso_events(spark, d), "iso", ["user_id"], "event_id")


@query(_ISO_GROUPS + "select event_id, case when pays and dv > 0 then 'T+' || dv when pays and dv < 0 then 'T' || dv else iso end as cell, iso as again from y join p on y.user_id is not distinct from p.user_id")
def delta_temporal_iso(spark, d):
    coded = deltas.temporal(_iso_events(spark, d), "iso", ["user_id"], "event_id", "cell").select("user_id", "event_id", "cell")
    return deltas.temporal_back(coded, "cell", ["user_id"], "event_id", "again").select("event_id", "cell", "again")


@query("select conv_id, turn, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as bigint) as user_turn from conversations")
def turn_numbering(spark, d):
    return context.numbered(table(spark, d, "conversations")).select("conv_id", "turn", "user_turn")


_TOKENS = "greatest(1, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint))"


@query(f"""with r as (select *, sum({_TOKENS}) over (partition by conv_id order by turn desc) as run from conversations), o as (select *, max(case when run > 200 then turn end) over (partition by conv_id) as over_ from r)
select conv_id, cast(coalesce(min(case when role = 'user' and turn >= over_ then turn end), -1) as bigint) as cut from o group by conv_id""")
def ageing_cut(spark, d):
    return context.ageing_cut(table(spark, d, "conversations"), 200)


@query(f"""with n as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as ut from conversations), m as (select *, max(ut) over (partition by conv_id) as last from n)
select conv_id, count(*) filter (ut <= last - 2 and {_TOKENS} >= 50) as n_old from m group by conv_id""")
def recency_cut(spark, d):
    return context.recent(table(spark, d, "conversations"), 2)


@query("with m as (select conv_id, turn, min(turn) over (partition by conv_id, coalesce(text, '')) as same_as from conversations) select * from m where turn > same_as")
def dedup_turns(spark, d):
    return context.repeats(table(spark, d, "conversations"))


@query()
def pack_recency(spark, d):
    items = table(spark, d, "conversations").select("conv_id", "turn", fn.estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return context.packed(items, "conv_id", [(-F.col("turn")).alias("at")], "tokens", 300)


@query(r"""select page_id, length(replace(replace(html, 'https://', 'h//'), 'http://', 'h/')) as n_short from pages""")
def url_shorten(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(fn.shorten_urls(F.col("html"))).cast("long").alias("n_short"))


@query(r"""select doc_id, length(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')) as n_chars from documents""")
def collapse_blank_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(fn.collapse_blank_lines(F.col("text"))).cast("long").alias("n_chars"))


@query()
def doc_format_detection(spark, d):
    return table(spark, d, "documents").groupBy(fn.detect_format(F.col("text")).alias("format")).agg(F.count(F.lit(1)).alias("docs"))


@query("select 'nation [' || (select count(*) from nation) || ']{n_nationkey|n_name|n_regionkey}:' || chr(10) || string_agg('  ' || n_nationkey || '|' || n_name || '|' || n_regionkey, chr(10) order by n_nationkey) as encoded from nation")
def tabular_encode(spark, d):
    """The fixed table of nations as one compact text; its size doesn't grow with the data."""
    row = F.struct("n_nationkey", F.concat(F.lit("  "), F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey")).alias("line"))
    rows = table(spark, d, "nation").agg(F.array_sort(F.collect_list(row)).alias("a"))
    head = F.concat(F.lit("nation ["), F.size("a"), F.lit("]{n_nationkey|n_name|n_regionkey}:\n"))
    return rows.select(F.concat(head, F.array_join(F.col("a.line"), "\n")).alias("encoded"))


_LINES = "unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))))"


@query(rf"""with l as (select doc_id as id, z[1] as line, cast(z[2] as integer) as pos from (select doc_id, {_LINES} as z from documents)),
t as (select id, pos, line, list_filter(list_distinct(regexp_split_to_array(lower(line), '[^a-z0-9_]+')), lambda x: x in ('der', 'und', 'oution', 'license')) as t, count(*) over (partition by id) as n from l),
h as (select id, pos, n, line, unnest(t) as q from t), w as (select id, pos, line, ln(1 + n / (1.0 + count(*) over (partition by id, q))) as w from h),
s as (select id, pos, line, sum(w) as score, row_number() over (partition by id order by round(sum(w), 9) desc, pos) as place from w group by id, pos, line)
select id, pos, length(line) as n_chars, cast(round(score * 1000) as bigint) as score from s where place <= 3""")
def tfidf_top_lines(spark, d):
    best = search.best_lines(table(spark, d, "documents"), "Find the license of der und oution", 3)
    return best.select("id", "pos", F.length("line").cast("long").alias("n_chars"), F.round(F.col("score") * 1000).cast("long").alias("score"))


_HITS = "len(list_filter(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda x: length(x) > 1), lambda x: starts_with(x, '{1}') or (starts_with('{1}', x) and {2})))"


@query("with s as (select p_partkey, cast(" + " + ".join(f"{n} * {_HITS.format(c, q, len(q) >= 4)}" for q in ("large", "bolt", "promotion") for n, c in ((3, "p_name"), (1, "p_type"))) + """ as bigint) as score from part)
select * from s where score > 0 order by score desc, p_partkey limit 20""")
def tool_search_topk(spark, d):
    return search.best_tools(table(spark, d, "part"), "Large bolt, promotion", 20, "p_name", "p_type", "p_partkey")


_FACTS = ", ".join("{{'category': '{}', 'fact': regexp_extract(coalesce(text, ''), '{}', 1, 'i')}}".format(c, p.replace("'", "''")) for c, p in texts.FACTS)


@query(rf"""with f as (select doc_id, unnest([{_FACTS}]) as f from documents)
select doc_id, f.category as category, regexp_replace(regexp_replace(f.fact, '^\s+|\s+$', '', 'g'), '[.!,;]+$', '') as fact from f where f.fact <> ''""")
def facts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(texts.facts(F.col("text"))).alias("f")).select("doc_id", "f.category", "f.fact")


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, cast(sum(length(line) - length(regexp_extract(line, '^( *)', 1)) // 2 + 1) - 1 as bigint) as n_chars from l group by doc_id""")
def indent_compress(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(texts.compress_indent(F.col("text"))).cast("long").alias("n_chars"))


@query(r"""with h as (select doc_id, text, substring(text, 1, 120) as h from documents), c as (select *, regexp_extract(h, '(?s)^(.*[.!?])', 1) as s, regexp_extract(h, '(?s)^(.*)\s', 1) as w from h)
select doc_id, case when length(text) <= 120 then text else regexp_replace(case when s <> '' then s when w <> '' then w else h end, '\s+$', '') || '…' end as short from c""")
def sentence_truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.truncate_at_sentence(F.col("text"), 120).alias("short"))


@query("""with s as (select o_orderkey, o_orderkey * 1737 // 1000 as s from orders) select o_orderkey, case when s < 60 then s || 's'
else concat_ws(' ', case when s >= 3600 then (s // 3600) || 'h' end, (s % 3600 // 60) || 'm', case when s % 60 > 0 then (s % 60) || 's' end) end as took from s""")
def duration_format(spark, d):
    return table(spark, d, "orders").select("o_orderkey", texts.format_duration(F.col("o_orderkey") * 1737).alias("took"))


# Existence only: a class of neighbours stands for the lookarounds that DuckDB lacks.
_SEEN = {
    "jwt": r"(^|[^A-Za-z0-9_])eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}($|[^A-Za-z0-9_])",
    "aws-access-key": r"(^|[^A-Za-z0-9_])(AKIA|ASIA|AGPA|ANPA|AIDA|AROA|AIPA|ANVA|ABIA|ACCA)[A-Z0-9]{16}($|[^A-Za-z0-9_])",
    "aws-secret-key": r"""(?i)aws[_-]?secret[_-]?access[_-]?key["'']?\s*[:=]\s*["'']?[A-Za-z0-9/+=]{40}($|[^A-Za-z0-9_])""",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}",
    "ssn": r"(^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9-])",
    "ipv4": r"(^|[^A-Za-z0-9_.-])((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])($|[^A-Za-z0-9_.-])",
    "phone": r"(^|[^A-Za-z0-9_+])\+?[0-9]{1,3}[-. ]?\(?[0-9]{2,4}\)?[-. ]?[0-9]{3,4}[-. ]?[0-9]{3,4}($|[^A-Za-z0-9_])",
}


@query("select " + ", ".join(f"""count(*) filter (regexp_matches(text, '{p}')) as "{k.replace('-', '_')}" """ for k, p in _SEEN.items()) + " from documents")
def pii_presence_by_kind(spark, d):
    docs = table(spark, d, "documents")
    return docs.agg(*[F.count_if(privacy.has(F.col("text"), k)).alias(k.replace("-", "_")) for k in privacy.PLAIN])


@query()
def pii_redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", privacy.redact(F.col("text")).alias("redacted"))


@query()
def pii_counts(spark, d):
    """Spans by kind, cards by Luhn and IPv6 addresses included."""
    spans = table(spark, d, "documents").select(F.explode(privacy.spans(F.col("text"))).alias("s"))
    return spans.groupBy(F.col("s.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""select page_id, length(regexp_replace(html, '(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}):00(\.0+)?(Z?)', '\1\3', 'g')) as n_chars from pages""")
def ts_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(fn.drop_zero_seconds(F.col("html"))).cast("long").alias("n_chars"))


@query("""with w as (select doc_id, list_avg(list_transform(string_split(text, ' '), lambda x: length(x))) as m from documents where text is not null)
select doc_id, case when m <= 1 then 1 when m <= 3 then 3 when m <= 8 then 5 when m <= 20 then 7 else 9 end as tenths from w""")
def doc_value_length(spark, d):
    w = F.transform(F.split("text", " "), F.length)
    mean = F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(w)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(fn.value_length_score(mean) * 10).cast("int").alias("tenths"))


@query("""with l as (select doc_id as id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
b as (select id, pos, pos - row_number() over (partition by id order by pos) as island from l where line = '')
select id, min(pos) as start, count(*) as n from b group by id, island having count(*) >= 2""")
def blank_runs(spark, d):
    return text.blank_runs(table(spark, d, "documents"))


@query("""with v as (select distinct reverse(p_name) as v from part where p_name is not null), p as (select v, lag(v) over (partition by v[1:6] order by v) as u from v),
x as (select distinct v[1:n] as s from (select v, u, (select max(i) from range(0, length(v) + 1) r(i) where v[1:i] = u[1:i] and i <= length(u)) as n from p where u is not null) where n >= 6)
select reverse(s) as suffix, count(*) as n from x join v on starts_with(v.v, x.s) and v.v <> x.s group by s having count(*) >= 3""")
def suffix_candidates(spark, d):
    return text.adjacent_suffixes(table(spark, d, "part"), "p_name")


@query("""with v as (select distinct c_name as v from customer where c_name is not null), w as (select distinct v, v[i:i + n - 1] as part from v, (values (16), (12), (8)) z(n), range(1, 200) r(i) where i + n - 1 <= length(v)),
c as (select part, count(*) as n, greatest(1, cast(ceil(length(part) / 4.0) as bigint)) as tokens from w group by part)
select part, n, tokens from c where n >= 2 and (tokens - 1) * n > tokens + 3""")
def substring_candidates(spark, d):
    return text.substring_candidates(table(spark, d, "customer"), "c_name", (16, 12, 8))


@query("""with v as (select distinct 'c_name' as col, c_name as v from customer where c_name is not null union all select distinct 'p_name', p_name from part where p_name is not null),
s as (select col, max(length(v)) as most, 2 * count(*) filter (length(v) < 12) > count(*) as dense from v group by col),
z as (select col, n from s, (values (64), (48), (40), (32), (24), (20), (16), (12), (10), (8), (6), (5)) z(n) where n <= most and most >= 6 and (n > 5 or dense)),
w as (select distinct col, v, v[i:i + n - 1] as part from v join z using (col), range(1, 1000) r(i) where i + n - 1 <= length(v)),
c as (select col, part, count(*) as n, greatest(1, cast(ceil(length(part) / 4.0) as bigint)) as tokens from w group by col, part)
select col, part, n, tokens from c where n >= 2 and (tokens - 1) * n > tokens + 3""")
def substring_candidates_adaptive(spark, d):
    """Widths from each column's lengths, over customers' and parts' names; substring_candidates is the part of three widths over customers."""
    columns = [(table(spark, d, t).select(c), c) for t, c in (("customer", "c_name"), ("part", "p_name"))]
    found = [text.substring_candidates(v, c, text.window_widths(v, c)).select(F.lit(c).alias("col"), "part", "n", "tokens") for v, c in columns]
    return found[0].unionAll(found[1])


@query("""select doc_id, length(replace(replace(translate(text, chr(8220) || chr(8221) || chr(8216) || chr(8217) || chr(8211) || chr(160), '""' || chr(39) || chr(39) || '- '), chr(8212), '--'), chr(8230), '...')) as n_chars from documents""")
def plain_characters(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(lossy.plain_characters(F.col("text"))).cast("long").alias("n_chars"))


@query("select event_id, case when length(props) > 10 then props[1:6] || '...' else props end as short from events")
def value_truncation(spark, d):
    return table(spark, d, "events").select("event_id", lossy.truncate_value(F.col("props"), 10, 6).alias("short"))


@query("select doc_id, len(string_split(text, chr(10))) as n_lines, array_to_string(string_split(text, chr(10))[-5:], chr(10)) as tail from documents where text is not null")
def tail_truncation(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), lossy.tail_lines(F.col("text"), 5).alias("tail"))


@query("""with r as (select o_orderpriority as profile, o_custkey, max(case when o_orderkey % 2 = 0 then (o_orderkey // 2 % 3 > 0)::int end) as p, max(case when o_orderkey % 2 = 1 then (o_orderkey // 2 % 4 > 0)::int end) as c from orders group by all)
select profile, count(*) as pairs, count(*) filter (p = 1) as plain_right, count(*) filter (c = 1) as compact_right, count(*) filter (p = 1 and c = 0) as only_plain, count(*) filter (p = 0 and c = 1) as only_compact
from r where p is not null and c is not null group by profile""")
def eval_frontier(spark, d):
    """Orders as answers: even keys plain, odd ones compact, a customer being a task and a priority a profile."""
    key = F.col("o_orderkey")
    half = F.floor(key / 2)
    right = F.when(key % 2 == 0, half % 3 > 0).otherwise(half % 4 > 0)
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("profile"), "o_custkey", F.when(key % 2 == 0, "plain").otherwise("compact").alias("format"), right.alias("correct"))
    return evaluation.matched(rows, ["o_custkey"], ["profile"]).drop("p_value")


@query()
def pack_balanced(spark, d):
    """Conversations packed by 0.6 of priority, longer texts first, and 0.4 of recency."""
    m = table(spark, d, "conversations").withColumn("tokens", fn.estimate_tokens(F.coalesce("text", F.lit(""))))
    w = Window.partitionBy("conv_id")
    score = 0.6 * F.col("tokens") / F.max("tokens").over(w) + 0.4 * F.col("turn") / F.greatest(F.max("turn").over(w), F.lit(1))
    return context.packed(m.withColumn("score", score), "conv_id", [(-F.col("score")).alias("at"), F.col("turn").alias("pos")], "tokens", 300)


@query("select l_orderkey, count(*) as n_items, true as same from lineitem group by l_orderkey")
def codec_roundtrip(spark, d):
    """Each order's lines as JSON, compacted and expanded again; an order has few lines, so the groups are small."""
    item = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", F.col("l_shipdate").cast("string").alias("shipped"))
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = orders.select("l_orderkey", F.struct("l_orderkey", "items").alias("o"))
    kind = rows.schema["o"].dataType
    back = F.from_json(codec.expand(codec.compact(F.to_json("o"))), kind)
    return rows.select("l_orderkey", F.size("o.items").cast("long").alias("n_items"), (F.to_json(back) == F.to_json("o")).alias("same"))


@query()
def codec_savings(spark, d):
    """Estimated tokens of each order's lines as JSON and as compact text, by how many lines it has."""
    item = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items")).select(F.size("items").cast("long").alias("n_items"), F.to_json("items").alias("j"))
    tokens = rows.select("n_items", fn.estimate_tokens(F.col("j")).alias("plain"), fn.estimate_tokens(codec.compact(F.col("j"))).alias("compact"))
    return tokens.groupBy("n_items").agg(F.sum("plain").alias("plain"), F.sum("compact").alias("compact"))
