"""The operators as queries over the driver's tables, and DuckDB SQL for their results where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact, lines, mixing, near, pii, quality, substring, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    return chat.digest(chat.format_table(rows.unionByName(own)))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over records of four layouts, one a turn of ``conversations``, each turn's text as a question and its role as the answer."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("q"), F.coalesce("role", F.lit("")).alias("a"))
    one = lambda role, text, names: F.struct(F.lit(role).alias(names[0]), F.col(text).alias(names[1]))
    talk = lambda names, roles: F.array(one(roles[0], "q", names), one(roles[1], "a", names))
    records = [
        F.struct(talk(("role", "content"), ("user", "assistant")).alias("messages"), F.col("conv_id").alias("id")),
        F.struct(talk(("from", "value"), ("human", "gpt")).alias("conversations")),
        F.struct(F.col("q").alias("prompt"), F.col("a").alias("response")),
        F.struct(F.col("a").alias("output"), F.col("q").alias("instruction"), F.lit("x").alias("origin")),
    ]
    which = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    json = F.to_json(records[3])
    for k in range(3):
        json = F.when(which == k, F.to_json(records[k])).otherwise(json)
    out = chat.format_json(rows.select("conv_id", "turn", json.alias("json")), "json")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", "turn", "layout", F.sha2(turns, 256).alias("turns_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(_read(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(_read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(_read(spark, sf_dir, "documents"), threshold=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, _read(spark, sf_dir, "labels"), threshold=0.3).drop("text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.size("spans").cast("long").alias("n_private"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=80)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, _read(spark, sf_dir, "labels"), threshold=0.7).drop("text")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "chat_layouts": chat_layouts,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_minhash_near": op4_minhash_near,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_decontam": op8_decontam,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLES = {
    "op1_chat_format": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(role) + length(text)
    + length(regexp_replace(role || text, '[^<\[\\]', '', 'g'))
    + case when role = 'assistant' then 9 else 8 end + 8 + 7) as bigint) as formatted_chars
from t group by conv_id""",
    "chat_layouts": r"""
select conv_id, turn, ['messages', 'conversations', 'prompt_response', 'instruction'][1 + (conv_id + turn) % 4] as layout,
  sha256('user' || chr(10) || coalesce(text, '') || chr(10) || 'assistant' || chr(10) || coalesce(role, '') || chr(10)) as turns_sha256
from conversations""",
    "op2_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
z as (select doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: {'pos': i, 'run': md5(array_to_string(w[i:i+19], ' '))})) as z from d where len(w) >= 20),
x as (select doc_id, z.pos as pos, row_number() over (partition by z.run order by doc_id, z.pos) > 1 as again from z),
g as (select distinct doc_id, unnest(range(pos, pos + 20)) as pos from x where again),
o as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
k as (select o.doc_id, count(g.pos) as n, string_agg(word, ' ' order by o.pos) filter (g.pos is null) as kept
  from o left join g on g.doc_id = o.doc_id and g.pos = o.pos group by o.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id""",
    "op3_line_dedup": r"""
with l as (
  select doc_id, u.pos as pos, u.line as line,
    translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(list_zip(string_split(coalesce(text, ''), chr(10)), range(len(string_split(coalesce(text, ''), chr(10)))))) as z from documents) x,
    lateral (select z[1] as line, z[2] as pos) u),
bad as (select key from l where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (key in (select key from bad)) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (key not in (select key from bad)), '')) as kept_sha256
from l group by doc_id""",
    "op4_minhash_near": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) as g from w where len(w) > 0),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
r(doc_id, other) as (select a, b from e union select r.doc_id, e.b from r join e on r.other = e.a),
c as (select doc_id, min(other) as least from r group by doc_id)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) as component_id,
  w.doc_id = least(w.doc_id, coalesce(c.least, w.doc_id)) as kept
from w left join n on n.doc_id = w.doc_id left join c on c.doc_id = w.doc_id""",
    "op5_mixing": rf"""
with d as (select doc_id, source, {_WORDS} as size, md5(cast(doc_id as varchar)) as hash from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from s),
c as (select *, 3 * source_size as cap, sum(source_size) over () as total, sum(w) over () as weight,
  coalesce(sum(3 * source_size) over (order by 3 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as cap_before,
  coalesce(sum(w) over (order by 3 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as w_before from w),
l as (select *, cast(total - cap_before as double) / cast(weight - w_before as double) as level from c),
t as (select source, source_size, least(cast(cap as double),
  coalesce((select arg_min(level, cap / w) from l where level * w <= cap), 0) * w) as target from l),
e as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as times from t),
r as (select d.doc_id, d.size, e.source_size, e.target, e.times, e.target - e.times * e.source_size as rest,
  sum(d.size) over (partition by d.source order by d.hash) as upto
  from d join e on d.source is not distinct from e.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(size * (times + case when rest > 0 and upto - size / 2 <= rest then 1 else 0 end) as bigint) as taken from r""",
    "op8_decontam": r"""
with w as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
  union all select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') from benchmark),
g as (select distinct kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) as g from w where len(w) > 0),
n as (select id, count(*) as n_item from g where kind = 'b' group by id),
s as (select d.id as doc_id, b.id as item_id, count(*) as n_shared from g d join g b on d.g = b.g where d.kind = 'd' and b.kind = 'b' group by 1, 2)
select doc_id, item_id, n_shared, n_item from s join n on s.item_id = n.id where 100 * n_shared >= 80 * n_item""",
    "op10_exact_dedup": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from t""",
}
