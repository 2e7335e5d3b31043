"""Which format a text has, with a confidence: (format, confidence, reason) from whole texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column

from tamarack.functions import formats
from tamarack.functions.codec import HEADER, _strict

# Cues of Markdown and their weights; the first two exclude each other.
MARKDOWN = (
    (r"\A\s*#{1,6}\s+\S", 0.9), (r"(?m)^#{2,6}\s+\S", 0.8), (r"\|[\s\-:]+\|", 0.85), (r"\*\*[^*]+\*\*|__[^_]+__", 0.3),
    (r"(?m)^[-*]\s+\[[ x]\]", 0.3), (r"(?m)^```", 0.3), (r"\[[^\]]+\]\([^)]+\)", 0.75),
)
# Cues of code families.
PYTHON = r"(?m)^\s*(?:def\s+\w+\(|class\s+\w+|import\s+\w|from\s+\w[\w.]*\s+import\b|elif\b|except\b|@\w+)|:\s*$"
C_FAMILY = r"(?m)\b(?:function|const|let|var|public|private|static|void|int|return|struct|impl|fn|func)\b|[;{}]\s*$"


@dataclass
class Found:
    format: str
    confidence: float
    reason: str
    body_at: int = 0


def _json(text: str) -> Found | None:
    if text[:1] not in ("{", "["):
        return None
    try:
        _strict(text)
        return Found("json", 0.99, "valid JSON")
    except (ValueError, RecursionError):
        pass
    try:
        _strict(formats.strip_comments(text))
        return Found("json", 0.95, "valid JSON once comments are gone")
    except (ValueError, RecursionError):
        return Found("json", 0.7, "brackets, but no valid JSON")


def _delimited(lines: list[str], delimiter: str) -> Found | None:
    bare = [re.sub(r'"[^"]*"', "", x) for x in lines]
    counts = [x.count(delimiter) for x in bare]
    even = sum(abs(c - counts[0]) <= 1 for c in counts) / len(counts)
    head = formats.split_row(lines[0], delimiter)
    if not counts[0] or even < 0.8:
        return None
    if all(re.fullmatch(r"-?[\d.]+", x) for x in head) or any(len(x.split()) > 4 for x in head) or re.match(r"\s*[\w-]+:\s", lines[0]):
        return None
    exact = sum(c == counts[0] for c in counts) == len(counts)
    name = {",": "commas", "\t": "tabs", ";": "semicolons"}[delimiter]
    return Found("csv", 0.95 if exact and counts[0] >= 2 else 0.9 if exact else 0.85, f"even {name} in {len(lines)} lines")


def _csv(lines: list[str]) -> Found | None:
    full = [x for x in lines if x.strip()]
    if len(full) < 3:
        return None
    found = [f for d in formats.DELIMITERS if (f := _delimited(full, d))]
    return max(found, key=lambda f: f.confidence, default=None)


def _markdown(text: str) -> Found | None:
    score, hits = 0.0, []
    for i, (cue, weight) in enumerate(MARKDOWN):
        if re.search(cue, text) and not (i == 1 and hits == [0]):
            score += weight
            hits.append(i)
    if not hits:
        return None
    if score > 1:
        score = 0.75 + (score - 0.75) * 0.15
    return Found("markdown", round(min(0.95, max(0.75, score)) if score >= 0.3 else 0.0, 2), f"{len(hits)} cues of Markdown") if score >= 0.6 else None


def _yaml(lines: list[str]) -> Found | None:
    pairs = full = lists = nested = 0
    fenced = False
    for line in lines:
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif line.strip() and not fenced and not line.lstrip().startswith("#"):
            full += 1
            pairs += bool(re.match(r"\s*(?:- )?[\w.\"'-]+:(?:\s|$)", line))
            lists += bool(re.match(r"\s*- \S", line))
            nested += line.startswith("  ")
    if lines and lines[0].strip() == "---":
        return Found("yaml", 0.9, "document mark")
    if not full or (pairs + lists) / full < 0.6 or not pairs:
        return None
    return Found("yaml", min(0.9, 0.6 + 0.2 * pairs / full + 0.05 * bool(nested) + 0.05 * bool(lists)), f"{pairs} of {full} lines are pairs")


def envelope(text: str) -> int | None:
    """Where the body of an HTTP response begins, behind a status line, one header or more and an empty line."""
    m = re.match(r"HTTP/\d(?:\.\d)? \d{3}[^\n]*\n(?:[A-Za-z0-9-]+:[^\n]*\n)+\r?\n", text)
    return m.end() if m else None


def detect(text: str) -> Found:
    """A response's body by its own cues; compact text by its header; valid JSON; else the most confident of JSON, CSV, Markdown and YAML, earlier ones on ties; else text at 0.5."""
    at = envelope(text)
    if at is not None:
        inner = detect(text[at:])
        return Found(inner.format, inner.confidence, f"behind an envelope: {inner.reason}", at)
    body = text.strip()
    lines = body.split("\n")
    if lines[0].startswith(HEADER.split()[0] + " ") or re.match(r"[A-Za-z_][\w.-]* \[\d+\]\{[^}]+\}:\s*$", lines[0]):
        return Found("compact", 1.0, "its header")
    first = _json(body)
    if first and first.confidence >= 0.95:
        return first
    found = [f for f in (first, _csv(lines), _markdown(body), _yaml(lines)) if f]
    return max(found, key=lambda f: f.confidence, default=Found("text", 0.5, "no cues"))


def looks_like_code(text: str) -> bool:
    """Three lines or more with words and with structure of code."""
    words = re.search(r"\b(?:def|class|function|import|return|const|let|var|public|private|static|void|fn|func|struct|impl)\b", text)
    shape = re.search(r"(?m)[;{}]\s*(?://.*)?$|^\s*(?:def|class)\s.*:\s*(?:#.*)?$|=>|\)\s*:\s*$", text)
    return text.count("\n") >= 2 and bool(words and shape)


def code_family(text: str) -> str:
    """python or c, by which has more cues."""
    return "python" if len(re.findall(PYTHON, text)) > len(re.findall(C_FAMILY, text)) else "c"


def detected(text: Column) -> Column:
    """``format, confidence, reason, body_at``; null of a null text."""
    return formats.mapped(lambda s: detect(s).__dict__, schema="format string, confidence double, reason string, body_at int")(text)
