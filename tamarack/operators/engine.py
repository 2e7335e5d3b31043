"""Conversations and sessions under a budget: packing, history, facts, shared and rolling dictionaries, a cache of texts."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tamarack.functions import estimate_tokens, layers, tokens

# Tokens kept back, shares of a balanced order, place from which the rest is packed tighter, bounds of the cache and of the rolling dictionary, characters of a repeat's key and of its remark, share of the ceiling from which to summarise.
RESERVE, PRIORITY, RECENCY, TIGHT = 50, 0.6, 0.4, 0.7
CACHE_BYTES, CACHE_TEXTS, IDLE_TURNS, MOST_ROLLING = 10 << 20, 500, 20, 100
KEY, REMARK, FULL = 200, 60, 0.6


def pack(items: DataFrame, key: str, strategy: str, budget: int, pos: str = "pos", size: str = "tokens", priority: str = "priority") -> DataFrame:
    """``items`` with ``place`` (0 first), ``ratio``, ``kept`` and ``tight``.

    Greedy by group: in the strategy's order (priority, recency or balanced;
    ties by position) an item is kept while it fits, larger ones are skipped.
    A fold over a group's sizes alone decides; rows meet it by their place.
    """
    all_ = Window.partitionBy(key)
    score = {"priority": F.col(priority), "recency": F.col(pos), "balanced": PRIORITY * F.col(priority) + RECENCY * F.col(pos) / F.greatest(F.max(pos).over(all_), F.lit(1))}[strategy]
    w = all_.orderBy(F.desc("__score"), pos)
    rows = items.withColumn("__score", score).withColumn("place", F.row_number().over(w) - 1).withColumn("ratio", F.percent_rank().over(w)).drop("__score")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def fold(done: Column, x: Column) -> Column:
        fits = done["used"] + x["t"] <= budget - RESERVE
        return F.struct((done["used"] + F.when(fits, x["t"]).otherwise(0)).cast("long").alias("used"), F.concat(done["kept"], F.array(fits)).alias("kept"))

    sizes = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", F.col(size).cast("long").alias("t")))).alias("a"))
    flags = sizes.select(F.col(key).alias("__k"), F.posexplode(F.aggregate("a", start, fold)["kept"]).alias("__p", "kept"))
    return rows.join(flags, rows[key].eqNullSafe(flags["__k"]) & (rows["place"] == flags["__p"])).drop("__k", "__p").withColumn("tight", F.col("ratio") >= TIGHT)


def pack_stats(packed: DataFrame, key: str, size: str = "tokens") -> DataFrame:
    """By group: items and tokens kept and dropped."""
    return packed.groupBy(key).agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"), F.sum(F.when(F.col("kept"), F.col(size)).otherwise(0)).cast("long").alias("used"), F.sum(size).cast("long").alias("total"))


def deduplicated(messages: DataFrame) -> DataFrame:
    """``messages`` whose text's first characters and length an earlier turn has, with a remark in its place. Alike texts that differ later count as equal, by design."""
    text = F.coalesce("text", F.lit(""))
    first = F.min("turn").over(Window.partitionBy("conv_id", F.substring(text, 1, KEY), F.length(text)))
    remark = F.concat(F.lit("[Same as turn "), first.cast("string"), F.lit(": "), F.substring(text, 1, REMARK), F.lit("...]"))
    return messages.withColumn("text", F.when((F.col("turn") > first) & (text != ""), remark).otherwise(F.col("text")))


def to_summarise(messages: DataFrame, ceiling: int) -> DataFrame:
    """``conv_id, tokens, full``: whether a conversation is over 60% of the ceiling."""
    size = F.sum(estimate_tokens(F.coalesce("text", F.lit("")))).alias("tokens")
    return messages.groupBy("conv_id").agg(size).withColumn("full", F.col("tokens") > FULL * ceiling)


def index_messages(facts: DataFrame) -> DataFrame:
    """``conv_id, text`` from ``conv_id, turn, category, fact``: each conversation's distinct facts under their categories, both by first occurrence."""
    first = facts.groupBy("conv_id", "category", "fact").agg(F.min("turn").alias("turn"))
    per = first.groupBy("conv_id", "category").agg(F.min(F.struct("turn", "category")).alias("at"), F.array_sort(F.collect_list(F.struct("turn", "fact"))).alias("f"))
    part = F.concat(F.lit("## "), F.col("category"), F.lit("\n"), F.array_join(F.transform("f", lambda x: F.concat(F.lit("- "), x["fact"])), "\n"))
    parts = per.select("conv_id", F.struct("at", part.alias("part")).alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return parts.select("conv_id", F.concat(F.lit("# Index\n"), F.array_join(F.transform("ps", lambda p: p["part"]), "\n")).alias("text"))


def shared_rewrite(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """``messages`` with the lines of a shared dictionary (``alias, line``; 64 at most, so broadcast as one map) as ``%alias``; a literal % at a line's start is doubled."""
    table = lines.agg(F.map_from_entries(F.collect_list(F.struct("line", "alias"))).alias("__d"))
    one = lambda x: F.coalesce(F.concat(F.lit("%"), F.element_at("__d", x)), F.when(x.startswith("%"), F.concat(F.lit("%"), x)).otherwise(x))
    return messages.join(F.broadcast(table)).withColumn("text", F.array_join(F.transform(F.split("text", "\n"), one), "\n")).drop("__d")


def shared_restore(messages: DataFrame, lines: DataFrame) -> DataFrame:
    table = lines.agg(F.map_from_entries(F.collect_list(F.struct("alias", "line"))).alias("__d"))
    one = lambda x: F.when(x.startswith("%%"), F.substring(x, F.lit(2), F.length(x))).otherwise(F.when(x.startswith("%"), F.coalesce(F.element_at("__d", F.substring(x, F.lit(2), F.length(x))), x)).otherwise(x))
    return messages.join(F.broadcast(table)).withColumn("text", F.array_join(F.transform(F.split("text", "\n"), one), "\n")).drop("__d")


def optimised(messages: DataFrame, facts: DataFrame, ceiling: int) -> DataFrame:
    """``conv_id, ord, role, text``: each full conversation's index, then its messages; of a full one, turns that an index stands for go down to their remark."""
    full = to_summarise(messages, ceiling).where("full").select("conv_id")
    index = index_messages(facts).join(full, "conv_id", "left_semi").select("conv_id", F.lit(-1).cast("long").alias("ord"), F.lit("system").alias("role"), "text")
    return index.unionByName(deduplicated(messages).select("conv_id", F.col("turn").cast("long").alias("ord"), "role", "text"))


@dataclass
class TextCache:
    """Texts by digest, the least recently used go first beyond CACHE_BYTES or CACHE_TEXTS."""

    most_bytes: int = CACHE_BYTES
    most: int = CACHE_TEXTS
    sizes: OrderedDict = field(default_factory=OrderedDict)
    hits: dict = field(default_factory=dict)
    misses: int = 0

    def see(self, text: str) -> bool:
        """Whether the text is known; either way it is now the latest."""
        key = tokens.digest(text)
        known = key in self.sizes
        if known:
            self.sizes.move_to_end(key)
            self.hits[key] = self.hits.get(key, 0) + 1
        else:
            self.misses += 1
            self.sizes[key] = len(text.encode())
            while len(self.sizes) > self.most or sum(self.sizes.values()) > self.most_bytes:
                old, _ = self.sizes.popitem(last=False)
                self.hits.pop(old, None)
        return known

    def stats(self) -> dict:
        n = sum(self.hits.values())
        return {"hits": n, "misses": self.misses, "rate": n / (n + self.misses) if n + self.misses else 0.0, "bytes": sum(self.sizes.values()), "saved": sum(self.sizes[k] * h for k, h in self.hits.items())}


@dataclass
class RollingDictionary:
    """Entries that texts of a session have shared, to seed the next text's dictionary."""

    turn: int = 0
    entries: dict = field(default_factory=dict)  # value -> [found, last used, uses, tokens]

    def seeds(self) -> list[str]:
        """The next turn's: entries used in the last IDLE_TURNS, the oldest first, 52 at most."""
        self.turn += 1
        self.entries = {v: e for v, e in self.entries.items() if self.turn - e[1] <= IDLE_TURNS}
        return sorted(self.entries, key=lambda v: (self.entries[v][0], v))[: layers.ENTRIES]

    def update(self, uses: dict[str, int], safe: bool = True) -> None:
        """After a text whose dictionary used each value so often; nothing is learnt from a text that may hold personal data."""
        if not safe:
            return
        for v, n in uses.items():
            if v in self.entries:
                self.entries[v][1:3] = [self.turn, self.entries[v][2] + 1]
            elif n >= 2:
                self.entries[v] = [self.turn, self.turn, 1, tokens.estimate(v)]
        while len(self.entries) > MOST_ROLLING:
            del self.entries[min(self.entries, key=lambda v: (self.entries[v][2] * self.entries[v][3], self.entries[v][0], v))]

    def saved(self) -> int:
        return sum((e[2] - 1) * e[3] for e in self.entries.values())


def _rolled(rows: pd.DataFrame, state: RollingDictionary) -> pd.DataFrame:
    out = []
    for turn, text in zip(rows["turn"], rows["text"], strict=True):
        seeds = state.seeds()
        got = layers.compact(text or "", seeds=tuple(seeds))
        table = layers.split_dict(got.text)[0] if got.entries else {}
        uses = layers.entry_uses(got.text) if table else {}
        state.update({v: uses[a] for a, v in table.items()})
        out.append((turn, len(seeds), got.entries, got.tokens_before, got.tokens_after, state.saved()))
    return pd.DataFrame(out, columns=["turn", "n_seeds", "n_entries", "tokens_before", "tokens_after", "rolling_saved"])


ROLLED = "turn long, n_seeds long, n_entries long, tokens_before long, tokens_after long, rolling_saved long"


def rolled(rows: DataFrame, session: str) -> DataFrame:
    """``rows`` (session, ``turn, text``) in order through one rolling dictionary a session: tokens before and after. A session's state depends on its order, so each is one group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = _rolled(part.sort_values("turn"), RollingDictionary())
        out.insert(0, session, part[session].iloc[0])
        return out

    kind = rows.schema[session].dataType.simpleString()
    return rows.select(session, "turn", "text").groupBy(session).applyInPandas(run, f"{session} {kind}, {ROLLED}")


def seen_before(rows: DataFrame, session: str) -> DataFrame:
    """A stream of ``session, turn, text``: whether the session's cache knows each text. The state is the cache, bounded by CACHE_TEXTS."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = TextCache()
        if state.exists:
            kept = json.loads(state.get[0])
            cache.sizes, cache.hits, cache.misses = OrderedDict(kept[0]), kept[1], kept[2]
        for part in parts:
            part = part.sort_values("turn")
            yield pd.DataFrame({session: key[0], "turn": part["turn"], "known": [cache.see(t or "") for t in part["text"]]})
        state.update((json.dumps([list(cache.sizes.items()), cache.hits, cache.misses]),))

    kind = rows.schema[session].dataType.simpleString()
    return rows.select(session, "turn", "text").groupBy(session).applyInPandasWithState(run, f"{session} {kind}, turn long, known boolean", "cache string", "append", GroupStateTimeout.NoTimeout)


def batch(rows: DataFrame, text: str, workers: int = 10) -> DataFrame:
    """``rows`` with ``result`` and ``error``, order kept by the rows' own columns: a fault in one text is that row's error. ``workers`` tasks work at a time."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            out = []
            for t in s:
                try:
                    out.append((None if t is None else layers.compact(t).text, None))
                except Exception as e:  # reported with its row
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["result", "error"])

    done = F.pandas_udf(run, "result string, error string")
    return rows.repartition(workers).withColumn("__r", done(F.col(text))).select(*rows.columns, "__r.result", "__r.error")
