"""Usage statistics over a call log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions import half_up


def session_stats(calls: DataFrame, key: str = "format") -> DataFrame:
    """Calls, tokens, savings, lossy share and mean latency by key; one combined aggregate."""
    saved = F.col("input_tokens") - F.col("output_tokens")
    return calls.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(saved).alias("saved_tokens"),
        F.count_if(~F.col("reversible")).alias("lossy_calls"),
        half_up(F.avg(F.col("duration_ms").cast("decimal(18,4)"))).alias("avg_ms"),
    )


def latency_percentiles(calls: DataFrame, key: str = "format") -> DataFrame:
    """Nearest-rank percentiles: the value of rank ceil(q n)."""
    q = lambda p, name: F.expr(f"percentile_disc({p}) within group (order by duration_ms)").alias(name)
    return calls.groupBy(key).agg(q(0.5, "p50"), q(0.95, "p95"), q(0.99, "p99"))


def daily_zero_filled(calls: DataFrame, days: int = 7) -> DataFrame:
    """The last ``days`` UTC days of the log, days without calls as zeros."""
    day = F.to_date("ts")
    per = calls.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") - F.col("output_tokens")).alias("saved"))
    last = calls.agg(F.max(day).alias("last"))
    span = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias("d"))
    return span.join(per, F.col("d") == F.col("day"), "left").select(F.col("d").cast("string").alias("day"), F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved"))


def archive(calls: DataFrame) -> DataFrame:
    """Sums by UTC day and format, which later sums can be made of."""
    return calls.groupBy(F.to_date("ts").cast("string").alias("day"), "format").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def from_archive(archived: DataFrame) -> DataFrame:
    return archived.groupBy("format").agg(F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def top_format(calls: DataFrame) -> DataFrame:
    """The format with most calls; ties go to the first by name."""
    per = calls.groupBy("format").agg(F.count(F.lit(1)).alias("calls"))
    return per.orderBy(F.desc("calls"), "format").limit(1)


def savings_report(calls: DataFrame) -> DataFrame:
    """Calls that saved tokens and those that didn't, by action."""
    saved = F.col("input_tokens") - F.col("output_tokens")
    return calls.groupBy("action").agg(F.count_if(saved > 0).alias("saved_calls"), F.count_if(saved <= 0).alias("skipped_calls"), F.sum(F.greatest(saved, F.lit(0))).alias("saved_tokens"))


def latest(rows: DataFrame, time_col: str, id_col: str, keep: int = 100) -> DataFrame:
    """The newest rows, which a history retains."""
    return rows.orderBy(F.desc(time_col), F.desc(id_col)).limit(keep)


#: US dollars for a million tokens, in and out, of five models.
PRICES = [
    ("claude-sonnet", 3.0, 15.0),
    ("claude-opus", 15.0, 75.0),
    ("claude-haiku", 0.8, 4.0),
    ("gpt-4o", 2.5, 10.0),
    ("gpt-4o-mini", 0.15, 0.6),
]


def cost_saved(calls: DataFrame) -> DataFrame:
    """What saved input tokens would have cost in each model, in micro-dollars; five price rows are broadcast."""
    prices = calls.sparkSession.createDataFrame(PRICES, "model string, usd_in double, usd_out double")
    total = calls.agg(F.sum(F.col("input_tokens") - F.col("output_tokens")).alias("saved"))
    return F.broadcast(prices).crossJoin(total).select("model", half_up(F.col("saved") * F.col("usd_in")).alias("micro_usd"))
