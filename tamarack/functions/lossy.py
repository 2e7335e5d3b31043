"""Transforms that lose detail to save tokens, all in the JVM. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what stands for each in ASCII.
ASCII = {"“": '"', "”": '"', "‘": "'", "’": "'", "—": "--", "–": "-", "…": "...", " ": " "}
# Words in value positions and their short forms.
VALUES = {"true": "T", "false": "F", "null": "~"}
# Beginnings of model names and their tokenizer's family, exact for these.
FAMILIES = (
    ("gpt-4o", "o200k_base"), ("gpt-4.1", "o200k_base"), ("o1", "o200k_base"), ("o3", "o200k_base"), ("o4", "o200k_base"), ("chatgpt-4o", "o200k_base"),
    ("gpt-4", "cl100k_base"), ("gpt-3.5", "cl100k_base"),
)


def plain_characters(text: Column) -> Column:
    one = {k: v for k, v in ASCII.items() if len(v) == 1}
    out = F.translate(text, "".join(one), "".join(one.values()))
    for k, v in ASCII.items():
        if k not in one:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def _short(value: Column, kept: Column) -> Column:
    out = F
    for word, short in VALUES.items():
        out = out.when(value == word, F.lit(short))
    return out.otherwise(kept)


def abbreviate_values(text: Column) -> Column:
    """Words of VALUES that are a key's whole value or a whole cell between bars; lines that begin with @ or % stay."""
    pair = r"^(\s*\S+:\s+)(true|false|null)$"

    def line(x: Column) -> Column:
        value = F.regexp_extract(x, pair, 2)
        keyed = F.when(value != "", F.concat(F.regexp_extract(x, pair, 1), _short(value, value))).otherwise(x)
        indent = F.regexp_extract(keyed, r"^(\s*)", 1)
        cells = F.transform(F.split(F.substring(keyed, F.length(indent) + 1, F.length(keyed)), r"\|"), lambda c: _short(F.regexp_replace(c, r"^\s+|\s+$", ""), c))
        return F.when(x.rlike(r"^\s*[@%]"), x).when(F.contains(keyed, F.lit("|")), F.concat(indent, F.array_join(cells, "|"))).otherwise(keyed)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def truncate_value(text: Column, most: int = 50, keep: int = 40) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def tail_lines(text: Column, lines: int = 30) -> Column:
    """The last lines of a tool's result."""
    rows = F.split(text, "\n")
    return F.when(F.size(rows) > lines, F.array_join(F.slice(rows, -lines, lines), "\n")).otherwise(text)


def tokenizer_family(model: Column) -> Column:
    """(family, exact): unknown and null names count as cl100k_base, not exactly."""
    named = F
    for prefix, family in FAMILIES:
        named = named.when(model.startswith(prefix), F.lit(family))
    named = named.otherwise(F.lit(None).cast("string"))
    return F.struct(F.coalesce(named, F.lit("cl100k_base")).alias("family"), named.isNotNull().alias("exact"))
