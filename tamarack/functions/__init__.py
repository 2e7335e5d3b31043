"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity, -2.5 to -2."""
    return F.floor(x + 0.5).cast("long")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def structural_overhead(text: Column, most: int = 32768) -> Column:
    """Share of brackets, quotes, separators and white space in the first ``most`` characters; 0 of an empty text."""
    head = F.substring(text, 1, most)
    return F.when(F.length(text) == 0, 0.0).otherwise(F.regexp_count(head, F.lit(r'[{}\[\]",:\n\r\t ]')) / F.least(F.length(text), F.lit(most)))


def repetition_density(values: Column) -> Column:
    """Share of values that repeat an earlier one."""
    return F.when(F.size(values) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(values)) / F.size(values))


def value_length_score(mean: Column) -> Column:
    # Bounds of the mean length and their scores.
    return F.when(mean <= 1, 0.1).when(mean <= 3, 0.3).when(mean <= 8, 0.5).when(mean <= 20, 0.7).otherwise(0.9)


def alias_name(k: Column) -> Column:
    """$a to $z, then $aa, $bb and so on to $az: the name of place k from 0 to 51."""
    letter = lambda i: F.chr(F.lit(97) + i)
    return F.when(k < 26, F.concat(F.lit("$"), letter(k))).otherwise(F.concat(F.lit("$a"), letter(k - 26)))


def shorten_urls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "https://", "h//"), "http://", "h/")


def drop_zero_seconds(text: Column) -> Column:
    """ISO times without seconds that are zero."""
    return F.regexp_replace(text, r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}):00(\.0+)?(Z?)", "$1$3")


def strip_trailing(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+(?=\n|$)", "")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def detect_format(text: Column) -> Column:
    """A format's name by cues that need no parser: JSON by its brackets, CSV by even commas, Markdown by its marks, YAML by its keys; else text."""
    t = F.trim(F.coalesce(text, F.lit("")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    commas = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    even = F.size(F.filter(commas, lambda c: F.abs(c - commas[0]) <= 1)) / F.greatest(F.size(commas), F.lit(1))
    keys = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(- )?[A-Za-z_][A-Za-z0-9_-]*:( |$)"))) / F.greatest(F.size(lines), F.lit(1))
    marks = F.size(F.filter(lines, lambda x: x.rlike(r"^(#{1,6} |[-*] |\d+\. |```|> |\|.*\|)")))
    return (
        F.when(t.startswith("{") | t.startswith("["), F.when(F.try_parse_json(t).isNotNull(), "json").otherwise("text"))
        .when((F.size(lines) >= 3) & (commas[0] >= 1) & (even >= 0.8), "csv")
        .when(marks >= 2, "markdown")
        .when((F.size(lines) >= 2) & (keys >= 0.6), "yaml")
        .otherwise("text")
    )


def luhn_valid(digits: Column) -> Column:
    """The check digit of 13 to 19 digits."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: x.cast("int") * (1 + i % 2))
    total = F.aggregate(d, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return F.length(digits).between(13, 19) & (total % 10 == 0)
