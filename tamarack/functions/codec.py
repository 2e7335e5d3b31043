"""The compact text of JSON values, and back. Keys of uniform records are written once, braces and most quotes not at all."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The format's marks. A quoted key is never a mark.
HEADER, ROOT, VALUE, EMPTY, STEP = "@from json", "_root", "_value", "{}", "  "
# What would be read as another type or as syntax, so that a string has to be quoted.
_OTHER = re.compile(r"null|true|false|~|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|[+-][1-9]\d*|T[+-](?:0|[1-9]\d*)", re.ASCII)
_SYNTAX = re.compile(r'[:|,"\\\n\t\r]|^[$%]| %')
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}
_BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")
_QUOTED = r'"(?:[^"\\]|\\.)*"'
_LINE = re.compile(rf'(?P<key>{_QUOTED}|[A-Za-z_][A-Za-z0-9_.-]*)(?P<empty> \{{\}})?(?: \[(?P<n>\d+)\](?:\{{(?P<fields>.*)\}})?)?(?P<colon>:)?(?: (?P<rest>.*))?', re.DOTALL)
_ATOM = (str, int, float, bool, type(None))


def number(x: int | float) -> str:
    """The shortest decimal of a double, without a fraction if it has none; exponents from 1e21 and under 1e-6. Integers of any size are exact."""
    if isinstance(x, int) or x == int(x) and abs(x) < 1e21:
        return str(int(x))
    d = Decimal(repr(x)).normalize()
    if 1e-6 <= abs(x) < 1e21:
        return format(d, "f")
    sign, digits, _ = d.as_tuple()
    tail = "".join(map(str, digits[1:]))
    return f"{'-' * sign}{digits[0]}{'.' * bool(tail)}{tail}e{d.adjusted():+d}"


def _quoted(s: str) -> str:
    return '"' + "".join(_ESCAPES.get(c, c) for c in s) + '"'


def _unquoted(s: str) -> str:
    back = {v[1]: k for k, v in _ESCAPES.items()}
    return re.sub(r"\\(.)", lambda m: back[m[1]], s[1:-1], flags=re.DOTALL)


def _atom(v, cell: bool = False) -> str:
    if v is None or isinstance(v, bool):
        return json.dumps(v)
    if not isinstance(v, str):
        return number(v)
    plain = v and v == v.strip() and not _OTHER.fullmatch(v) and not _SYNTAX.search(v) and not (cell and " " in v)
    return v if plain else _quoted(v)


def _key(k: str) -> str:
    return k if _BARE.fullmatch(k) and k not in (ROOT, VALUE) else _quoted(k)


def _entry(key: str, v) -> list[str]:
    """Lines of one entry; those after the first are indented."""
    if isinstance(v, dict):
        return [f"{key} {EMPTY}"] if not v else [key, *(STEP + x for k, w in v.items() for x in _entry(_key(k), w))]
    if not isinstance(v, list):
        return [f"{key}: {_atom(v)}"]
    head = f"{key} [{len(v)}]"
    if all(isinstance(x, _ATOM) for x in v):
        return [f"{head}: {','.join(map(_atom, v))}"]
    names = list(v[0]) if isinstance(v[0], dict) else []
    if names and all(isinstance(x, dict) and x.keys() == v[0].keys() and all(isinstance(y, _ATOM) for y in x.values()) for x in v):
        return [f"{head}{{{'|'.join(map(_key, names))}}}:", *(STEP + "|".join(_atom(x[n], cell=True) for n in names) for x in v)]
    out = [f"{head}:"]
    for x in v:
        lines = [y for k, w in x.items() for y in _entry(_key(k), w)] if isinstance(x, dict) else _entry(VALUE, x)
        out += [STEP + "- " + (lines or [EMPTY])[0], *(STEP * 2 + y for y in lines[1:])]
    return out


def encode(value) -> str:
    if isinstance(value, dict):
        lines = [x for k, v in value.items() for x in _entry(_key(k), v)]
    else:
        lines = _entry(ROOT if isinstance(value, list) else VALUE, value)
    return "\n".join([HEADER, *lines])


def _read(s: str):
    if s.startswith('"'):
        return _unquoted(s)
    if s in ("null", "true", "false") or _OTHER.fullmatch(s) and s[-1].isdigit() and s[0] not in "+T":
        return json.loads(s)
    return s


def _cells(s: str, mark: str) -> list[str]:
    return re.findall(rf"{_QUOTED}|[^{re.escape(mark)}]+", s, re.DOTALL)


@dataclass
class _Reader:
    lines: list[tuple[int, str]]
    at: int = 0
    seen: int = field(default=0, repr=False)

    def body(self, depth: int) -> dict:
        """Entries at a depth; the key of a mark is a tuple, which no other key is."""
        out = {}
        while self.at < len(self.lines) and self.lines[self.at][0] == depth:
            self.entry(depth, out)
        return out

    def entry(self, depth: int, out: dict) -> None:
        m = _LINE.fullmatch(self.lines[self.at][1])
        if not m:
            raise ValueError(f"not an entry: {self.lines[self.at][1][:80]}")
        self.at += 1
        key = m["key"]
        key = _unquoted(key) if key[0] == '"' else (key,) if key in (ROOT, VALUE) else key
        if m["empty"]:
            out[key] = {}
        elif m["fields"] is not None:
            names = [_read_key(x) for x in _cells(m["fields"], "|")]
            out[key] = [dict(zip(names, map(_read, _cells(self.row(depth + 1), "|")), strict=True)) for _ in range(int(m["n"]))]
        elif m["n"] is not None:
            inline = m["rest"] is not None
            out[key] = [_read(x) for x in _cells(m["rest"], ",")] if inline else [self.item(depth + 1) for _ in range(int(m["n"]))]
            if len(out[key]) != int(m["n"]):
                raise ValueError(f"{key}: {m['n']} values announced, {len(out[key])} found")
        elif m["colon"]:
            out[key] = _read(m["rest"] or "")
        else:
            out[key] = _whole(self.body(depth + 1))

    def row(self, depth: int) -> str:
        if self.at >= len(self.lines) or self.lines[self.at][0] != depth:
            raise ValueError("rows are missing")
        self.at += 1
        return self.lines[self.at - 1][1]

    def item(self, depth: int):
        text = self.row(depth)
        if text == "- " + EMPTY:
            return {}
        if not text.startswith("- "):
            raise ValueError("an item without its dash")
        self.at -= 1
        self.lines[self.at] = (depth + 1, text[2:])
        return _whole(self.body(depth + 1), VALUE)


def _read_key(s: str) -> str:
    return _unquoted(s) if s[0] == '"' else s


def _whole(body: dict, *marks: str):
    for mark in marks:
        if body.keys() == {(mark,)}:
            return body[(mark,)]
    return {k[0] if isinstance(k, tuple) else k: v for k, v in body.items()}


def decode(text: str):
    """The value of a compact text; ValueError for anything else."""
    head, *rest = text.split("\n")
    if head != HEADER:
        raise ValueError("not a compact text")
    reader = _Reader([((len(x) - len(x.lstrip(" "))) // 2, x.lstrip(" ")) for x in rest])
    body = reader.body(0)
    if reader.at < len(rest):
        raise ValueError(f"line {reader.at + 2} is indented too far")
    return _whole(body, ROOT, VALUE)


def _strict(s: str):
    def refuse(x):
        raise ValueError(x)

    return json.loads(s, parse_constant=refuse, parse_float=lambda x: refuse(x) if abs(float(x)) == float("inf") else float(x))


def _or_same(f):
    """Texts that a codec can't read come back unchanged; null stays null."""

    def one(s):
        try:
            return None if s is None else f(s)
        except (ValueError, RecursionError):
            return s

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one)

    return F.pandas_udf(run, "string")


def compact(text: Column) -> Column:
    """JSON as compact text. Of repeated keys the last counts. NaN, infinite numbers and other text are not JSON and stay."""
    return _or_same(lambda s: encode(_strict(s)))(text)


def expand(text: Column) -> Column:
    """Compact text as JSON."""
    return _or_same(lambda s: json.dumps(decode(s), ensure_ascii=False, separators=(",", ":")))(text)
