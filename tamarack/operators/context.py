"""Conversations: turns, ageing, recency and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import estimate_tokens


def numbered(messages: DataFrame) -> DataFrame:
    """``user_turn``: how many user messages came up to here."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumn("user_turn", F.sum((F.col("role") == "user").cast("long")).over(w))


def ageing_cut(messages: DataFrame, ceiling: int) -> DataFrame:
    """By conversation: the first place to keep. Newest first, messages add up to the ceiling; the cut moves on to the next user message; -1 for none."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    run = messages.withColumn("run", F.sum(estimate_tokens(F.coalesce("text", F.lit("")))).over(newest))
    over = F.max(F.when(F.col("run") > ceiling, F.col("turn"))).over(Window.partitionBy("conv_id"))
    run = run.withColumn("over", over)
    return run.groupBy("conv_id").agg(F.coalesce(F.min(F.when((F.col("role") == "user") & (F.col("turn") >= F.col("over")), F.col("turn"))), F.lit(-1)).cast("long").alias("cut"))


def recent(messages: DataFrame, turns: int) -> DataFrame:
    """By conversation: messages older than the last ``turns`` user turns that are long enough to compact."""
    n = numbered(messages).withColumn("last", F.max("user_turn").over(Window.partitionBy("conv_id")))
    old = (F.col("user_turn") <= F.col("last") - turns) & (estimate_tokens(F.coalesce("text", F.lit(""))) >= 50)
    return n.groupBy("conv_id").agg(F.count_if(old).alias("n_old"))


def repeats(messages: DataFrame) -> DataFrame:
    """Messages that repeat an earlier turn's whole text in their conversation: ``conv_id, turn, same_as``. Digests, not prefixes, are compared."""
    w = Window.partitionBy("conv_id", F.sha2(F.coalesce("text", F.lit("")), 256))
    return messages.withColumn("same_as", F.min("turn").over(w)).where("turn > same_as").select("conv_id", "turn", "same_as")


def packed(items: DataFrame, key: str, order: list, tokens: str, budget: int) -> DataFrame:
    """Greedy packing by group: in order, items that still fit are kept, larger ones skipped. A fold over each group's sorted sizes, in the JVM."""
    fold = lambda s, x: F.when(s["used"] + x["t"] <= budget, F.struct((s["used"] + x["t"]).alias("used"), (s["n"] + 1).alias("n"))).otherwise(s)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"))
    rows = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(tokens).cast("long").alias("t")))).alias("a"))
    return rows.select(key, F.aggregate("a", start, fold).alias("s"), F.size("a").cast("long").alias("n_items")).select(key, F.col("s.used").alias("used"), F.col("s.n").alias("n_kept"), "n_items")


def right_answer(said: Column, want: Column, tolerance: float = 0.05) -> Column:
    """Whether an answer is the wanted one: equal once lower-cased and trimmed of white space, quotes and a last full stop, or numbers (signs of money and thousands aside) that differ by less than the tolerance."""
    tidy = lambda x: F.regexp_replace(F.lower(x), r"^[\s\"'`]+|[\s\"'`.]+$", "")
    value = lambda x: F.regexp_replace(tidy(x), r"^[$€£]|,|%$", "").try_cast("double")
    return F.coalesce(tidy(said) == tidy(want), F.lit(False)) | F.coalesce(F.abs(value(said) - value(want)) < tolerance, F.lit(False))
