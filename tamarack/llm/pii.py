"""Personal data by anchor expansion: an automaton finds anchors, local parsers grow and check the spans around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spans of the four base kinds are what the patterns of ``documents`` queries say, in this order of kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
# Anchors, and what may follow a cue.
_SCHEMES = ("http://", "https://", "ftp://")
_CUES = ("account", "acct", "iban", "ssn", "passport", "user id", "userid", "customer id", "member id", "licence no", "license no", "api key", "api_key", "token", "secret", "password")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HOST = re.compile(r"[A-Za-z0-9]")
_URL = re.compile(r"[^\s<>\"'`|\\^{}\[\]]+")
# Blank runs are possessive, so that none is tried at several lengths.
_VALUE = re.compile(r"[ \t]*+(?:(?:(?:no\.?|number)(?![A-Za-z0-9])|#)[ \t]*+)?(?:(?:[:=#]|is(?![A-Za-z0-9]))[ \t]*+)?[\"']?([A-Za-z0-9][A-Za-z0-9_-]{4,63})(?![A-Za-z0-9_-])", re.I)


def _automaton() -> ahocorasick.Automaton:
    """Over A-Z lower-cased text; value: kind of anchor and its length."""
    out = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), *((d, "digit") for d in "0123456789"), *((s, "url") for s in _SCHEMES), *((c, "cue") for c in _CUES)]:
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start and then kind as listed.

    Base kinds are leftmost and don't overlap within a kind: each parser
    remembers where its last match ended, whether that was valid or not.
    """
    out = []
    done = dict.fromkeys(KINDS, 0)  # up to where each kind's matches reach
    run = 0  # up to where the digits of the current run reach
    for last, (kind, size) in automaton.iter(text.translate(_ASCII_LOWER)):
        at = last - size + 1
        if kind == "digit":
            if at < run:
                continue
            run = at + 1
            while run < len(text) and text[run] in "0123456789":
                run += 1
            if at >= done["ip"] and (m := _QUAD.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
                    out.append(("ip", at, m.end()))
            if at >= done["card"] and (m := _CHAIN.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", at, m.end()))
        elif kind == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                out.append(("email", start, m.end()))
        elif kind == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append(("phone", at, m.end()))
        elif kind == "url":
            # a host begins with a letter or digit; what doesn't is refused unread
            if at >= done["url"] and _HOST.match(text, last + 1):
                m = _URL.match(text, last + 1)
                done["url"] = m.end()
                out.append(("url", at, last + 1 + len(m[0].rstrip(".,;:!?)"))))
        elif (at == 0 or not text[at - 1].isalnum()) and (m := _VALUE.match(text, last + 1)) and any(c in "0123456789" for c in m[1]) and m.start(1) >= done["account"]:
            done["account"] = m.end(1)
            out.append(("account", m.start(1), m.end(1)))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``<id>, spans`` with spans an array of (kind, start, end).

    Anchors are at-signs, plus signs, digits, URL schemes and identifier cues.
    From each a parser grows an e-mail address, phone number, IP address, card
    number, URL or account identifier to its bounds and checks it. Base kinds
    (``BASE``) are exactly the matches of their patterns; ``url`` and
    ``account`` (numbers, tokens and secrets behind a cue, quoted or not) are
    more, and may overlap them. Null and empty texts have none.
    Texts are scanned whole and in one pass; rows repeat as they come; further
    columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t.as_py() or "", automaton)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], [id_col, "spans"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, redacted``: each span, merged where spans overlap, as the first one's kind in angle brackets.

    Null texts come back empty; rows, ids and repeats stay as they are.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            out = []
            for t in batch.column(1):
                text, parts, at = t.as_py() or "", [], 0
                for name, start, end in find_spans(text, automaton):
                    if start >= at:
                        parts += [text[at:start], f"<{name}>"]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "redacted"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, redacted string")
