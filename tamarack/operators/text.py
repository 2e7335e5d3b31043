"""Lines, phrases and dictionaries of texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import estimate_tokens
from tamarack.operators.phrases import repeated_phrases


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, pos, line``."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))


def first_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """By document: lines, and lines of ``least`` characters or more that repeat an earlier one. Digests stand for texts in the shuffle."""
    per = lines(docs).groupBy("id", F.md5("line").alias("h")).agg(F.count(F.lit(1)).alias("n"), (F.first(F.length("line")) >= least).alias("long"))
    return per.groupBy("id").agg(F.sum("n").alias("n_lines"), F.sum(F.when(F.col("long"), F.col("n") - 1).otherwise(0)).alias("n_repeats"))


def line_runs(docs: DataFrame) -> DataFrame:
    """By document: runs of two or more equal lines and their lines, found where the line before differs."""
    w = Window.partitionBy("id").orderBy("pos")
    marked = lines(docs).select("id", F.col("line").eqNullSafe(F.lag("line").over(w)).alias("same"), "pos")
    marked = marked.withColumn("starts", F.lead("same").over(w) & ~F.col("same"))
    return marked.groupBy("id").agg(F.count_if("starts").alias("n_runs"), F.count_if("same").alias("n_collapsed"))


def shared_lines(rows: DataFrame, text_col: str = "text", least_tokens: int = 4, most: int = 64) -> DataFrame:
    """Lines worth an alias over all texts: two or more times, net of what writing the dictionary costs; the ``most`` best."""
    line = rows.select(F.explode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line"))
    count = line.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").withColumn("tokens", estimate_tokens(F.col("line")))
    net = (F.col("tokens") - 1) * F.col("n") - (F.col("tokens") + 3)
    return count.where(F.col("tokens") >= least_tokens).withColumn("net", net).where("net > 0").orderBy(F.desc("net"), F.desc("n"), "line").limit(most)


def phrase_candidates(docs: DataFrame, sizes: int | Sequence[int], text_col: str = "text", least: int = 2) -> DataFrame:
    """Runs of each of ``sizes`` words that pay for a dictionary entry, counted over all texts: of one size with a combined aggregate, of several in ``repeated_phrases``."""
    if not isinstance(sizes, int):
        several = [_paying(repeated_phrases(docs, more, text_col, least, _pays))] if (more := {k for k in sizes if k > 1}) else []
        return reduce(DataFrame.unionByName, [*several, *(phrase_candidates(docs, k, text_col, least) for k in set(sizes) - more)])
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[ \t\n\r]+"), lambda x: x != "")
    at = F.when(F.size("w") >= sizes, F.sequence(F.lit(1), F.size("w") - (sizes - 1))).otherwise(F.array().cast("array<int>"))
    every = F.transform(at, lambda i: F.array_join(F.slice("w", i, sizes), " "))
    grams = docs.select(words.alias("w")).select(F.explode(every).alias("phrase"))
    return _paying(grams.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))


def _pays(n: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """As ``_paying``, before a phrase is written."""
    tokens = np.maximum(1, -(-chars // 4))
    return (tokens - 1) * n > tokens + 3


def _paying(phrases: DataFrame) -> DataFrame:
    count = phrases.withColumn("tokens", estimate_tokens(F.col("phrase")))
    return count.withColumn("net", (F.col("tokens") - 1) * F.col("n") - (F.col("tokens") + 3)).where("net > 0")


def alias_candidates(values: DataFrame, value: str, least: int = 3) -> DataFrame:
    """Values of a column that pay for an alias."""
    count = values.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumn("tokens", estimate_tokens(F.col("value")))
    return count.withColumn("net", (F.col("tokens") - 1) * F.col("n") - (F.col("tokens") + 3)).where("net > 0")


def dictionary(candidates: DataFrame, most: int = 52) -> DataFrame:
    """``alias, value``: the best candidates, at most 52, named in order."""
    from tamarack.functions import alias_name

    best = candidates.orderBy(F.desc("net"), F.desc("n"), "value").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("net"), F.desc("n"), "value")) - 1
    return best.select(alias_name(place).alias("alias"), "value")


#: What reads as an alias; a literal one gets a dollar more in front.
_ALIAS = r"^\$+[a-z]{1,2}$"


def encode(rows: DataFrame, value: str, dictionary: DataFrame, out: str) -> DataFrame:
    """A dictionary has 52 entries at most, so it is broadcast. Values that read as an alias themselves are escaped."""
    d = F.broadcast(dictionary.select(F.col("alias").alias("__a"), F.col("value").alias("__v")))
    plain = F.when(F.col(value).rlike(_ALIAS), F.concat(F.lit("$"), value)).otherwise(F.col(value))
    return rows.join(d, F.col(value) == F.col("__v"), "left").withColumn(out, F.coalesce("__a", plain)).drop("__a", "__v")


def decode(rows: DataFrame, cell: str, dictionary: DataFrame, out: str) -> DataFrame:
    d = F.broadcast(dictionary.select(F.col("alias").alias("__a"), F.col("value").alias("__v")))
    plain = F.when(F.col(cell).rlike(r"^\$\$+[a-z]{1,2}$"), F.substring(F.col(cell), F.lit(2), F.length(cell))).otherwise(F.col(cell))
    return rows.join(d, F.col(cell) == F.col("__a"), "left").withColumn(out, F.coalesce("__v", plain)).drop("__a", "__v")


def merged(external: DataFrame, inline: DataFrame) -> DataFrame:
    """``alias, value`` of both dictionaries; the inline one's entries take precedence."""
    return external.join(F.broadcast(inline.select("alias")), "alias", "left_anti").unionByName(inline)


def collapsed_runs(text: Column) -> Column:
    """Runs of equal lines as one with its number, a literal mark escaped; empty lines and those that begin with @ or # stay. A fold over the text's lines, in its own row."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.replace(x, F.lit("(×"), F.lit("(\\×")))
    start = F.array().cast("array<struct<line:string,n:int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        same = F.coalesce((last["line"] == x) & (F.trim(x) != "") & ~x.rlike("^[@#]"), F.lit(False))
        more = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(x.alias("line"), (F.coalesce(last["n"], F.lit(0)) + 1).cast("int").alias("n"))))
        return F.when(same, more).otherwise(F.concat(done, F.array(F.struct(x.alias("line"), F.lit(1).alias("n")))))

    runs = F.aggregate(lines, start, step)
    return F.array_join(F.transform(runs, lambda r: F.when(r["n"] > 1, F.concat(r["line"], F.lit(" (×"), r["n"].cast("string"), F.lit(")"))).otherwise(r["line"])), "\n")


def expanded_runs(text: Column) -> Column:
    mark = r"^(.*) \(×(\d+)\)$"
    lines = F.transform(F.split(text, "\n"), lambda x: F.array_repeat(F.when(x.rlike(mark), F.regexp_extract(x, mark, 1)).otherwise(x), F.when(x.rlike(mark), F.regexp_extract(x, mark, 2).cast("int")).otherwise(1)))
    return F.replace(F.array_join(F.flatten(lines), "\n"), F.lit("(\\×"), F.lit("(×"))


def referenced_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, text``: later occurrences of a line of ``least`` characters or more as ``@L`` and the first one's place; other lines that begin with @ get one more. Each text in its own row."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    one = F.transform(F.col("l"), lambda x, i: F.when((F.length(x) >= least) & (F.array_position(F.col("l"), x) <= i), F.concat(F.lit("@L"), (F.array_position(F.col("l"), x) - 1).cast("string"))).otherwise(F.when(x.startswith("@"), F.concat(F.lit("@"), x)).otherwise(x)))
    return docs.select(F.col(id_col), lines.alias("l")).select(id_col, F.array_join(one, "\n").alias("text"))


def adjacent_prefixes(values: DataFrame, value: str, least: int = 8) -> DataFrame:
    """Longest common prefixes of neighbours among the sorted distinct values, of ``least`` characters or more, with the number of values that extend each.

    p is the longest common prefix of two neighbours exactly when values go on
    from it in two ways, one of which may be to end there. So each value's
    prefixes are counted by the character that follows, with a combined
    aggregate and no join, whatever all values have in common. Values count
    once, and as many prefixes as a value has characters.
    """
    v = values.select(F.col(value).alias("v")).where(F.col(value).isNotNull() & (F.length(value) >= least)).distinct()
    sizes = F.sequence(F.lit(least), F.length("v"))
    each = v.select(F.explode(F.transform(sizes, lambda n: F.struct(F.substring("v", F.lit(1), n).alias("prefix"), F.substring("v", n + 1, F.lit(1)).alias("next")))).alias("p"))
    ways = each.groupBy("p.prefix", "p.next").agg(F.count(F.lit(1)).alias("n"))
    found = ways.groupBy("prefix").agg(F.count(F.lit(1)).alias("ways"), F.sum(F.when(F.col("next") != "", F.col("n")).otherwise(0)).alias("n"))
    return found.where("ways >= 2 and n >= 3").select("prefix", "n")


def adjacent_suffixes(values: DataFrame, value: str, least: int = 6) -> DataFrame:
    """``suffix, n``: as adjacent_prefixes, of the values read backwards."""
    back = adjacent_prefixes(values.select(F.reverse(F.col(value)).alias("back")), "back", least)
    return back.select(F.reverse("prefix").alias("suffix"), "n")


def substring_candidates(values: DataFrame, value: str, widths: tuple[int, ...]) -> DataFrame:
    """``part, n, tokens``: windows of each width that occur in so many distinct values that an alias pays: (tokens - 1) n > tokens + 3, n at least 2."""
    v = values.select(F.col(value).alias("v")).where(F.col(value).isNotNull()).distinct()
    windows = lambda w: F.when(F.length("v") >= w, F.transform(F.sequence(F.lit(1), F.length("v") - w + 1), lambda i: F.substring("v", i, F.lit(w)))).otherwise(F.array().cast("array<string>"))
    every = v.select(F.explode(F.array_distinct(F.flatten(F.array(F.array().cast("array<string>"), *map(windows, widths))))).alias("part"))
    count = every.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").withColumn("tokens", estimate_tokens(F.col("part")))
    return count.where((F.col("tokens") - 1) * F.col("n") > F.col("tokens") + 3)


def window_widths(values: DataFrame, value: str) -> tuple[int, ...]:
    """The reference's ladder of widths, widest first, from one aggregate over the distinct values: up to the longest, and 5 where over half are shorter than 12; none if all are shorter than 6."""
    size = F.length(F.col(value))
    most, n, short = values.select(size.alias("n"), F.col(value)).where(F.col(value).isNotNull()).distinct().agg(F.max("n"), F.count("n"), F.count_if(F.col("n") < 12)).first()
    ladder = (64, 48, 40, 32, 24, 20, 16, 12, 10, 8, 6, *((5,) if n and 2 * short > n else ()))
    return tuple(w for w in ladder if w <= most) if (most or 0) >= 6 else ()


def blank_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of two empty lines or more: ``id, start, n``, start counted from 0. Each text's runs are found in its own row, without a shuffle."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    blank = lambda i: F.coalesce(F.try_element_at("l", i) == "", F.lit(False))
    begins = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: blank(i) & ((i == 1) | ~blank(F.greatest(i - 1, F.lit(1)))))
    ends = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: blank(i) & ~blank(i + 1))
    runs = docs.select(F.col(id_col).alias("id"), lines.alias("l")).select("id", F.explode(F.arrays_zip(begins.alias("b"), ends.alias("e"))).alias("r"))
    return runs.select("id", (F.col("r.b") - 1).cast("long").alias("start"), (F.col("r.e") - F.col("r.b") + 1).cast("long").alias("n")).where("n >= 2")
