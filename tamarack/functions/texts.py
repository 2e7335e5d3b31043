"""Text functions on columns: indents, shortening, durations, facts, search terms. Null in, null out, unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about what is sought.
STOPWORDS = frozenset(
    "the a an of to in on for and or is are was were be this that it as at by with what which who how many does do did has have from into about there any all show me find get list".split()
)
# Category of a fact, and the pattern whose first group is its text.
FACTS = (
    ("decision", r"(?:decided|chose|picked|selected|going with|let's use)\s+(.{10,80})"),
    ("error", r"(?:the (?:bug|issue|error|problem) (?:is|was))\s+(.{10,80})"),
    ("action", r"(?:fixed|resolved|solved)\s+(.{10,80})"),
    ("action", r"(?:created|added|built|implemented|wrote)\s+(.{10,80})"),
    ("requirement", r"(?:must|should|need to|requires?|has to)\s+(.{10,80})"),
    ("fact", r"(?:budget|deadline|constraint|limit)\s*(?:is|:)\s*(.{5,40})"),
    ("fact", r"(?:using|running|version)\s+(.{5,40})"),
)


def _by_line(text: Column, f) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), f), "\n")


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^( *)", 1))


def compress_indent(text: Column) -> Column:
    """One space for each two that begin a line."""
    return _by_line(text, lambda x: F.regexp_replace(x, r"\G  ", " "))


def expand_indent(text: Column) -> Column:
    """Two spaces for each that begins a line."""
    return _by_line(text, lambda x: F.concat(F.repeat(F.lit(" "), _indent(x)), x))


def normalize_whitespace(text: Column) -> Column:
    """Runs of spaces after a line's indent become one; none ends a line."""
    inner = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?<=\S) {2,}", " "), r"(?<=\S)\s+$", "")
    return _by_line(text, inner)


def truncate_at_sentence(text: Column, cap: int) -> Column:
    """Texts over ``cap`` characters end at the last sentence before it, else the last word, else at the cap, with an ellipsis."""
    head = F.substring(text, 1, cap)
    sentence, words = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1), F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    cut = F.when(sentence != "", sentence).when(words != "", words).otherwise(head)
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit("…")))


def format_duration(ms: Column) -> Column:
    """Like 1h 2m 3s: seconds only under a minute, no zero seconds above."""
    s = F.floor(ms / 1000).cast("long")
    h, m, rest = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(s < 60, part(s, "s")).when(s.isNotNull(), F.concat_ws(" ", F.when(h > 0, part(h, "h")), part(m, "m"), F.when(rest > 0, part(rest, "s"))))


def score_label(score: Column) -> Column:
    # Bounds and labels of a compressibility score.
    return F.when(score < 0.2, "low").when(score < 0.4, "moderate").when(score < 0.6, "good").when(score < 0.8, "high").when(score.isNotNull(), "excellent")


def score_profile(score: Column) -> Column:
    # Bounds of a compressibility score and the layers that it recommends.
    return F.when(score < 0.4, "structure").when(score < 0.6, "standard").when(score < 0.8, "tokenizer").when(score.isNotNull(), "semantic")


def facts(text: Column) -> Column:
    """Array of (category, fact): each pattern's first match, trimmed, without closing punctuation. Empty for null."""
    found = [F.struct(F.lit(c).alias("category"), F.regexp_extract(F.coalesce(text, F.lit("")), f"(?i){p}", 1).alias("fact")) for c, p in FACTS]
    tidy = lambda x: F.struct(x["category"], F.regexp_replace(F.regexp_replace(x["fact"], r"^\s+|\s+$", ""), "[.!,;]+$", "").alias("fact"))
    return F.transform(F.filter(F.array(*found), lambda x: x["fact"] != ""), tidy)


def terms(text: Column, stopwords: frozenset[str] = frozenset()) -> Column:
    """Lower-cased words of a-z, 0-9 and _ with two characters or more."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: F.length(x) > 1)
    return F.array_except(words, F.array(*map(F.lit, sorted(stopwords)))) if stopwords else words
