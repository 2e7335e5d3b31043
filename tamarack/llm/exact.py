"""Exact dedup by distributed MSD radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._skew import join_groups
from ._work import shared_dir, stash

#: Bytes of openings that a round broadcasts at about most: those of its largest groups.
HOT_BYTES = 4 << 20
#: A run of white space other than one plain space; replacing these alone gives the same text as replacing all runs.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def _split(rows: DataFrame, carry: str, text: str, first_bytes: int, growth: int, top: str, whole: bool = False) -> DataFrame:
    """``id, keep, n, sha, rid`` of ``rows`` (``id`` and the column ``carry``, of which ``text`` is the text) after all rounds; with ``whole`` also ``carry`` as ``row``."""
    norm = normalised(F.col(text)).cast("binary")
    active = rows.select("id", carry, F.sha2(norm, 256).alias("sha"), F.lit(0).cast("long").alias("gid"))
    done, width, offset, k = [], first_bytes, 0, 0
    while True:
        parts = active.withColumn("head", F.substring(norm, offset + 1, width)).withColumn("ended", F.length(norm) <= offset + width)
        groups = parts.groupBy("gid", "head", "ended").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep")).where("n > 1")
        groups = stash(groups.select("*", F.monotonically_increasing_id().alias("next"), F.col("ended").alias("end")), f"{top}/groups{k}")
        joined = join_groups(parts, groups, {c: c for c in ("gid", "head", "ended")}, "n", ["n", "keep", "next", "end"], ["id", "sha"], inner=False, most=max(16, min(1000, HOT_BYTES // width)))
        open_ = F.coalesce(~F.col("end"), F.lit(False))
        step = joined.select(
            "id",
            (F.col(carry) if whole else F.when(open_, F.col(carry))).alias(carry),
            "sha",
            open_.alias("open"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
            F.coalesce("n", F.lit(1)).cast("long").alias("n"),
            F.when(open_, F.col("next")).otherwise(0).cast("long").alias("gid"),
            F.monotonically_increasing_id().alias("rid"),
        )
        step = stash(step, f"{top}/step{k}")
        out = ["id", "sha", "keep", "n", F.concat(F.lit(f"{k}:"), F.col("rid").cast("string")).alias("rid")]
        done.append(step.where("not open").select(*out, *([F.col(carry).alias("row")] if whole else [])))
        active = step.where("open").select("id", carry, "sha", "gid")
        if active.isEmpty():
            return reduce(DataFrame.unionAll, done)
        offset, width, k = offset + width, width * growth, k + 1


def _firsts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``kept``: of the rows that have the id which stays, the first of each text."""
    first = rows.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("id", "sha").agg(F.min("rid").alias("first")).select("first")
    return rows.join(first, F.col("rid") == F.col("first"), "left").withColumn("kept", F.col("first").isNotNull()).drop("first")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_bytes: int = 256, growth: int = 8) -> DataFrame:
    """One row per input row: ``<id>, keep_id, group_size, kept, text_sha256``.

    Rounds of MSD radix partitioning over the bytes of the normalised text. A
    round splits each open group by its next bytes (``first_bytes`` at first,
    ``growth`` times as many in each later round). Rows alone in their group,
    and groups whose texts have ended, are done; only the rest goes on. Group
    sizes come from a combined aggregate; the groups that hold a large share of
    the rows are broadcast back to them and the others joined
    (``join_groups``), so that no task gets a hot group. Texts are compared
    byte by byte; the digest is output only.

    Null texts count as empty; empty texts equal each other. Null ids come
    last, so ``keep_id`` is null only if the whole group's ids are. Of rows
    that repeat both id and text, exactly one is kept. An empty table gives an
    empty result; further columns of ``docs`` are not looked at.
    """
    top = shared_dir(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = _firsts(_split(rows, "text", "text", first_bytes, growth, top))
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat an earlier text, all columns kept.

    Whole rows go through the rounds of ``exact_groups``, so texts are shuffled
    once a round and not again to be filtered. Of rows that repeat id and text,
    which are equal but for their other columns, one stays.
    """
    top = shared_dir(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole.alias("whole"))
    at = f"c{docs.columns.index(text_col)}"
    out = _firsts(_split(rows, "whole", f"whole.{at}", 256, 8, top, whole=True))
    return out.where("kept").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
