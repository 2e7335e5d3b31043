"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import shared_dir, stash

#: Hexadecimal digits of the hash that one histogram splits by: 4096 buckets.
_DIGITS, _LENGTH = 3, 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources in code-point order, null last, take the ``weights`` in turn. All
    sizes are shared in proportion; a target above ``most`` times its source's
    size stops there and the excess is shared again. That is
    ``least(most * size, level * weight)`` for one level, found by running sums
    over the sources in the order in which they stop. Works on one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    stops = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(every)).withColumn("weight", F.sum("w").over(every))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_ = F.col("weight") - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("level", left.cast("double") / open_.cast("double"))
    # the level that holds is that of the first source which it doesn't stop
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"]
    return per.withColumn("level", level).select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, rows_only: bool = False) -> DataFrame:
    """One row per input row: ``<id>, size, source_size, target, taken``; with ``rows_only`` all columns and ``copies``, of rows that are taken.

    Every document is taken ``floor(target / source_size)`` times; for what is
    left of the target, each source's documents whose hash is up to a threshold
    are taken once more. The threshold comes from nested histograms: sizes by
    source and by the next three digits of the hash; running sums find the
    bucket in which the budget ends, and only its documents go into the next,
    finer histogram, until a bucket holds one hash. A document is inside when
    at least half of it fits, so a source misses its target by half a document
    at most. Nothing is sorted by hash and the result depends on ids only.

    The hash is md5 of the id as text, or of the text where the id is null;
    rows that agree in it are taken together. Null or empty texts have size 0
    and are taken 0 words; a null source is one source, the last. Further
    columns are not looked at; with ``rows_only`` one named ``copies`` is
    replaced. An empty table gives an empty result.
    """
    spark, top = docs.sparkSession, shared_dir(docs.sparkSession)
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.coalesce(F.col(text_col), F.lit("")))))
    own = [F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("hash")]
    sizes = stash(docs.select(F.col(id_col).alias("id"), *own), f"{top}/sizes")
    targets = source_targets(sizes, weights, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("times", times.cast("long"))
    targets = stash(targets.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")), f"{top}/targets")
    # at: digits of the boundary bucket so far; below: words of the source in buckets before it
    bound = targets.where("rest > 0").select("source", "rest", F.lit("").alias("at"), F.lit(0).cast("long").alias("below"))
    ends = None
    for k in range(0, _LENGTH, _DIGITS):
        b = bound.select(F.col("source").alias("s"), "rest", "at", "below")
        part = sizes.where("size > 0").join(b, F.col("source").eqNullSafe(F.col("s")) & F.col("hash").startswith(F.col("at")) if k else F.col("source").eqNullSafe(F.col("s")))
        hist = part.groupBy("s", F.substring("hash", 1, k + _DIGITS).alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        sums = F.col("below") + F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))
        hist = hist.withColumn("upto", sums).withColumn("before", F.col("upto") - F.col("n"))
        # the last bucket that begins below the budget holds the boundary
        last = F.max(F.when(F.col("before") < F.col("rest"), F.col("bucket"))).over(Window.partitionBy("s"))
        edge = stash(hist.withColumn("last", last).where("bucket = last"), f"{top}/edge{k}")
        whole = F.col("before") + F.col("n") / 2 <= F.col("rest")
        one = edge.where("lo = hi").select(F.col("s").alias("source"), F.when(whole, F.col("hi")).otherwise(F.col("lo")).alias("limit"), whole.alias("with"))
        ends = one if ends is None else ends.unionAll(one)
        bound = edge.where("lo <> hi").select(F.col("s").alias("source"), "rest", F.col("bucket").alias("at"), F.col("before").alias("below"))
        if bound.isEmpty():
            break
    ends = ends.select(F.col("source").alias("e"), "limit", "with")
    per = targets.join(ends, F.col("source").eqNullSafe(F.col("e")), "left").select(F.col("source").alias("s"), "source_size", "target", "times", "limit", "with")
    more = F.coalesce((F.col("hash") < F.col("limit")) | ((F.col("hash") == F.col("limit")) & F.col("with")), F.lit(False))
    times = F.col("times") + more.cast("long")
    if rows_only:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"]).alias("row"), *own).join(per, F.col("source").eqNullSafe(F.col("s")))
        return rows.where((F.col("size") > 0) & (times > 0)).select("row.*", times.alias("copies"))
    return sizes.join(per, F.col("source").eqNullSafe(F.col("s"))).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"))
