"""Joins with a table of groups, some of which may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that are broadcast at most. A group is broadcast when it holds more than one in so many of the joined rows, so there can't be more.
MOST_HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: dict[str, str], count: str, take: list[str], spread: list[str | Column], inner: bool = True, total: int | None = None, most: int = MOST_HOT) -> DataFrame:
    """``rows`` with the columns ``take`` of the group that each belongs to.

    ``on`` maps columns of ``rows`` to those of ``groups`` (never null), whose
    rows are unique in them; ``count`` says how many of ``rows`` a group has.
    Groups of more than one in ``most`` rows, hence ``most`` at most, are
    broadcast, and their rows go on by a hash of ``spread`` alone; the others
    meet in a shuffle, where no key has more than one in ``most`` of the rows.
    Where keys are wide, a smaller ``most`` bounds the bytes of the broadcast.
    Rows without a group stay, with nulls, unless ``inner``. ``total`` is the
    sum of ``count`` or more than that, where it is known.
    """
    if total is None:
        total = groups.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * most > F.lit(int(total))
    keys = [F.col(f"`{g}`").alias(f"__k{i}") for i, g in enumerate(on.values())]
    found = F.struct(*[F.col(f"`{c}`") for c in take])
    few = groups.where(hot).select(*keys, found.alias("__hot"))
    # 0 as a value that the optimiser can't fold: a literal leaves the join's keys, and all rows of a hot group meet in one task
    cold = F.least(F.col(count), F.lit(0)).cast("long").alias("__cs")
    many = groups.where(~hot).select(*[F.col(f"`{g}`").alias(f"__c{i}") for i, g in enumerate(on.values())], cold, found.alias("__cold"))
    out = rows.join(F.broadcast(few), [F.col(f"`{r}`") == F.col(f"__k{i}") for i, r in enumerate(on)], "left")
    out = out.withColumn("__s", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 40)) + 1).otherwise(0).cast("long"))
    meet = [F.col(f"`{r}`") == F.col(f"__c{i}") for i, r in enumerate(on)] + [F.col("__s") == F.col("__cs")]
    out = out.join(many, meet, "left").withColumn("__g", F.coalesce("__hot", "__cold"))
    if inner:
        out = out.where(F.col("__g").isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"__g.`{c}`") for c in take])
