"""Whether a compact format is understood as well as the plain one: matched pairs, sign test, frontier of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sign_test(a: Column, b: Column) -> Column:
    """Two-sided p-value of the exact sign test of a against b discordant pairs; 1 without any. Binomials are summed as logarithms, so that no count overflows."""
    n, k = a + b, F.least(a, b)
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("tail"))

    def add(s: Column, i: Column) -> Column:
        log = F.when(i == 0, F.lit(0.0)).otherwise(s["log"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double")))
        return F.struct(log.alias("log"), (s["tail"] + F.exp(log - n * F.log(F.lit(2.0)))).alias("tail"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), start, add, lambda s: s["tail"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def matched(records: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """From rows ``<by>, <keys>, format, correct`` with formats plain and compact: pairs, pairs that only one format got right, and the sign test, by ``by``."""
    right = lambda f: F.max(F.when(F.col("format") == f, F.col("correct")))
    pairs = records.groupBy(*by, *keys).agg(right("plain").alias("p"), right("compact").alias("c")).where("p is not null and c is not null")
    only = lambda x, y: F.count_if(F.col(x) & ~F.col(y))
    counts = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("p").alias("plain_right"), F.count_if("c").alias("compact_right"), only("p", "c").alias("only_plain"), only("c", "p").alias("only_compact"))
    return counts.withColumn("p_value", sign_test(F.col("only_plain"), F.col("only_compact")))


def recommended(frontier: DataFrame, alpha: float = 0.05, tolerance: float = 0.02) -> DataFrame:
    """Of rows of ``matched`` by ``profile`` with ``savings``: that which saves most among those neither significantly worse than plain nor over ``tolerance`` below it; the first name of ties."""
    worse = (F.col("p_value") < alpha) & (F.col("only_plain") > F.col("only_compact"))
    within = F.col("compact_right") / F.col("pairs") >= F.col("plain_right") / F.col("pairs") - tolerance
    return frontier.where(~worse & within).orderBy(F.desc("savings"), "profile").limit(1)
