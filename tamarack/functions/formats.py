"""Texts of several formats as values, and values as texts. Values are what JSON has; keys keep their order."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.codec import _ATOM, _strict, number

_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII)
# Strings go first, so that a comment's marks inside one are not a comment.
_COMMENT = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?(?:\*/|\Z)', re.DOTALL)
# Delimiters, the first wins ties.
DELIMITERS = (",", "\t", ";")


def strip_comments(text: str) -> str:
    """Without ``//`` and ``/* */`` outside strings."""
    return _COMMENT.sub(lambda m: m[0] if m[0][0] == '"' else "", text)


def parse_json(text: str):
    """Strict JSON, or JSON once comments are gone."""
    try:
        return _strict(text)
    except ValueError:
        return _strict(strip_comments(text))


def split_row(line: str, delimiter: str) -> list[str]:
    """Cells of one line; in quotes a delimiter is text and two quotes are one. All cells lose white space at their ends."""
    cells, at, end = [], 0, len(line)
    while True:
        parts, quoted = [], False
        while at < end and (quoted or line[at] != delimiter):
            if line[at] != '"':
                parts.append(line[at])
            elif quoted and line[at + 1 : at + 2] == '"':
                parts.append('"')
                at += 1
            else:
                quoted = not quoted
            at += 1
        cells.append("".join(parts).strip())
        if at >= end:
            return cells
        at += 1


def sniff(lines: list[str]) -> str:
    """The delimiter under which most lines have as many cells as the first, which needs two."""
    best, share = ",", 0.0
    for d in DELIMITERS:
        width = [len(split_row(x, d)) for x in lines]
        even = sum(w == width[0] for w in width) / len(width)
        if width[0] >= 2 and even > share:
            best, share = d, even
    return best


def infer(cell: str):
    """A cell's value: empty and null, booleans, numbers as JSON writes them; else the text."""
    s = cell.strip()
    words = {"null": None, "NULL": None, "true": True, "TRUE": True, "false": False, "FALSE": False}
    if s in words:
        return words[s]
    return json.loads(s) if _NUMBER.fullmatch(s) else s


def parse_csv(text: str):
    """Rows as objects by the header's names; a lone line is ``_line``. Lines end cells, quoted or not."""
    lines = [x for x in text.replace("\r\n", "\n").strip().split("\n") if x.strip()]
    if len(lines) < 2:
        return [{"_line": lines[0] if lines else ""}]
    d = sniff(lines)
    names = split_row(lines[0], d)
    return [dict(zip(names, map(infer, (split_row(x, d) + [""] * len(names))[: len(names)]), strict=True)) for x in lines[1:]]


def yaml_scalar(raw: str):
    s = raw.strip()
    if s in ("", "~", "null"):
        return None
    if s in ("true", "false"):
        return s == "true"
    if _NUMBER.fullmatch(s):
        return json.loads(s)
    if len(s) >= 2 and s[0] == s[-1] == '"':
        try:
            return json.loads(s)
        except ValueError:
            return s[1:-1]
    if len(s) >= 2 and s[0] == s[-1] == "'":
        return s[1:-1].replace("''", "'")
    if s == "{}" or s == "[]":
        return json.loads(s)
    return s


_PAIR = re.compile(r'(?P<key>"(?:[^"\\]|\\.)*"|\'[^\']*\'|[^:\s"\'][^:]*?)\s*:(?:\s+(?P<rest>.*))?', re.DOTALL)


def parse_yaml(text: str):
    """Maps, lists and scalars by indentation; ``---``, ``...`` and lines of comment don't count."""
    rows = []
    for line in text.split("\n"):
        body = line.rstrip()
        if body.strip() and body.strip() not in ("---", "...") and not body.lstrip().startswith("#"):
            rows.append((len(body) - len(body.lstrip(" ")), body.lstrip(" ")))
    at = 0

    def block(depth: int):
        nonlocal at
        if at >= len(rows) or rows[at][0] < depth:
            return None
        depth = rows[at][0]
        return items(depth) if rows[at][1] == "-" or rows[at][1].startswith("- ") else pairs(depth)

    def items(depth: int) -> list:
        nonlocal at
        out = []
        while at < len(rows) and rows[at][0] == depth and (rows[at][1] == "-" or rows[at][1].startswith("- ")):
            rest = rows[at][1][1:]
            inner = rest.lstrip(" ")
            if not inner:
                at += 1
                out.append(block(depth + 1))
            elif _PAIR.fullmatch(inner) or inner.startswith("- "):
                rows[at] = (depth + 1 + len(rest) - len(inner), inner)
                out.append(block(depth + 1))
            else:
                at += 1
                out.append(yaml_scalar(inner))
        return out

    def pairs(depth: int) -> dict:
        nonlocal at
        out = {}
        while at < len(rows) and rows[at][0] == depth and (m := _PAIR.fullmatch(rows[at][1])):
            at += 1
            key = yaml_scalar(m["key"]) if m["key"][0] in "\"'" else m["key"]
            if m["rest"]:
                out[key] = yaml_scalar(m["rest"])
            else:
                dash = at < len(rows) and rows[at][0] == depth and rows[at][1].startswith("-")  # a list may stand under its key
                out[key] = items(depth) if dash else block(depth + 1)
        return out

    if len(rows) == 1 and not _PAIR.fullmatch(rows[0][1]) and not rows[0][1].startswith("- "):
        return yaml_scalar(rows[0][1])
    value = block(0)
    if at < len(rows):
        raise ValueError(f"not an entry: {rows[at][1][:80]}")
    return value


def parse(text: str, form: str):
    """The value of a text of format json, csv, yaml, markdown, text or compact; texts that have none are an object of themselves."""
    if form == "json":
        return parse_json(text)
    if form == "csv":
        return parse_csv(text)
    if form == "yaml":
        return parse_yaml(text)
    return {f"_{form}": text}


def _text(v) -> str:
    if v is None or isinstance(v, bool):
        return json.dumps(v)
    if isinstance(v, str):
        return v
    return number(v) if isinstance(v, int | float) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def to_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)


def _yaml_text(v) -> str:
    if not isinstance(v, str):
        return "{}" if v == {} else "[]" if v == [] else _text(v)
    plain = v == v.strip() and yaml_scalar(v) == v and not re.search(r"[\n\r\t]|^[-?:,\[\]{}#&*!|>'\"%@`]|: |:$| #", v)
    return v if plain else json.dumps(v, ensure_ascii=False)


def to_yaml(value) -> str:
    """Blocks; strings that would read as something else are quoted."""

    def lines(v) -> list[str]:
        if isinstance(v, dict) and v:
            out = []
            for k, w in v.items():
                key = k if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.-]*", k) else json.dumps(k, ensure_ascii=False)
                out += [f"{key}:", *("  " + x for x in lines(w))] if isinstance(w, dict | list) and w else [f"{key}: {_yaml_text(w)}"]
            return out
        if isinstance(v, list) and v:
            out = []
            for w in v:
                first, *rest = lines(w)
                out += ["- " + first, *("  " + x for x in rest)]
            return out
        return [_yaml_text(v)]

    return "\n".join(lines(value))


def _table(value) -> list[dict] | None:
    """The first list of flat objects, the value itself or one of its entries."""
    for v in [value, *(value.values() if isinstance(value, dict) else ())]:
        if isinstance(v, list) and v and all(isinstance(x, dict) and x.keys() == v[0].keys() and all(isinstance(y, _ATOM) for y in x.values()) for x in v):
            return v
    if isinstance(value, dict) and value and all(isinstance(v, _ATOM) for v in value.values()):
        return [value]
    return None


def to_csv(value) -> str:
    """The first table, or an object of plain values as one row; CRLF, null as an empty cell. ValueError for other values."""
    rows = _table(value)
    if rows is None:
        raise ValueError("no table")
    cell = lambda v: "" if v is None else '"' + s.replace('"', '""') + '"' if re.search(r'[",\r\n]|^\s|\s$', s := _text(v)) else s
    return "\r\n".join([",".join(map(cell, rows[0])), *(",".join(map(cell, r.values())) for r in rows)])


def widths(rows: list[dict]) -> dict[str, int]:
    """By column: the widest of its name and cells."""
    return {k: max(len(k), *(len(_text(r[k])) for r in rows)) for k in rows[0]}


def to_markdown(value) -> str:
    """A table, a table of keys and values, or headings with what they hold."""
    cell = lambda v: _text(v).replace("|", "\\|").replace("\n", " ")
    row = lambda cells: f"| {' | '.join(cells)} |"

    def table(rows: list[dict]) -> list[str]:
        return [row(map(cell, rows[0])), row(["---"] * len(rows[0])), *(row(map(cell, r.values())) for r in rows)]

    def section(v, level: int) -> list[str]:
        rows = _table(v) if isinstance(v, list) else None
        if rows:
            return table(rows)
        if isinstance(v, dict) and v:
            if all(isinstance(w, _ATOM) for w in v.values()):
                return [row(["Key", "Value"]), row(["---", "---"]), *(row([cell(k), cell(w)]) for k, w in v.items())]
            return [x for k, w in v.items() for x in ([f"**{k}**: {cell(w)}", ""] if isinstance(w, _ATOM) else [f"{'#' * min(level, 6)} {k}", "", *section(w, level + 1), ""])]
        if isinstance(v, list):
            return [f"- {cell(w)}" for w in v]
        return [cell(v)]

    return "\n".join(section(value, 2)).rstrip("\n")


def to_text(value) -> str:
    """Indented plain text, unquoted."""

    def lines(v) -> list[str]:
        if isinstance(v, dict):
            return [x for k, w in v.items() for x in ([f"{k}:", *("  " + y for y in lines(w))] if isinstance(w, dict | list) else [f"{k}: {_text(w)}"])]
        if isinstance(v, list):
            return [x for w in v for x in (lambda ls: ["- " + ls[0], *("  " + y for y in ls[1:])])(lines(w) or [""])]
        return [_text(v)]

    return "\n".join(lines(value))


SINKS = {"json": to_json, "yaml": to_yaml, "csv": to_csv, "markdown": to_markdown, "text": to_text}


def mapped(f, *args, schema: str = "string"):
    """A column function from one on texts; null in, null out; a text that it refuses gives null. Of a schema with several fields the function gives dicts."""
    names = [f.split()[0] for f in schema.split(", ")] if ", " in schema and "<" not in schema else None

    def one(s):
        try:
            return None if s is None else f(s, *args)
        except (ValueError, RecursionError):
            return None

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            if names:
                yield pd.DataFrame([one(x) or dict.fromkeys(names) for x in s], columns=names)
            else:
                yield pd.Series([one(x) for x in s], dtype=object)

    return F.pandas_udf(run, schema)


def parsed(text: Column, form: str) -> Column:
    """The text's value as JSON without blanks; null where it can't be read."""
    return mapped(lambda s: json.dumps(parse(s, form), ensure_ascii=False, separators=(",", ":")))(text)


def written(value: Column, form: str) -> Column:
    """A JSON text's value in another format; null where that has no way to say it."""
    return mapped(lambda s: SINKS[form](_strict(s)))(value)
