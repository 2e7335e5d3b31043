"""Personal data in text: kinds that are present, spans, redaction. Null in, null out."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds in their order of precedence, each with its label in redacted text and the pattern of its first
# group or whole match. Java and Python read them alike. Cards are checked by Luhn; ipv6 has a parser of its own.
KINDS: dict[str, tuple[str, str]] = {
    "jwt": ("TOKEN", r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}(?![A-Za-z0-9_])"),
    "aws-access-key": ("AWS_KEY", r"(?<![A-Za-z0-9_])(?:AKIA|ASIA|AGPA|ANPA|AIDA|AROA|AIPA|ANVA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Za-z0-9_])"),
    "aws-secret-key": ("AWS_SECRET", r"(?i)aws[_-]?secret[_-]?access[_-]?key[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9/+=]{40})(?![A-Za-z0-9_])"),
    "email": ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}"),
    "credit-card": ("CARD", r"(?<![A-Za-z0-9_])(?:[0-9][ -]?){12,18}[0-9](?![A-Za-z0-9_])"),
    "ssn": ("SSN", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "ipv6": ("IP6", r"[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}"),
    "ipv4": ("IP", r"(?<![A-Za-z0-9_.-])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![A-Za-z0-9_.-])"),
    "phone": ("PHONE", r"(?<![A-Za-z0-9_+])\+?[0-9]{1,3}[-. ]?\(?[0-9]{2,4}\)?[-. ]?[0-9]{3,4}[-. ]?[0-9]{3,4}(?![A-Za-z0-9_])"),
}
#: Kinds that a pattern alone decides.
PLAIN = tuple(k for k in KINDS if k not in ("credit-card", "ipv6"))
_COMPILED = {k: re.compile(p, re.ASCII) for k, (_, p) in KINDS.items()}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def has(text: Column, kind: str) -> Column:
    """Whether a text holds a kind of PLAIN; stays in the JVM."""
    if kind not in PLAIN:
        raise ValueError(f"{kind} needs spans()")
    return text.rlike(KINDS[kind][1])


def _luhn(value: str) -> bool:
    digits = [int(c) for c in reversed(value) if c.isdigit()]
    doubled = (d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def _address(value: str) -> bool:
    try:
        return ipaddress.IPv6Address(value) is not None
    except ValueError:
        return False


_CHECKS = {"credit-card": _luhn, "ipv6": _address}


def find(text: str, kinds: tuple[str, ...] = tuple(KINDS)) -> list[tuple[str, int, int, str]]:
    """Disjoint spans by start: of two that overlap the one that begins first stays, then that of the kind listed first."""
    found = []
    for place, kind in enumerate(KINDS):
        if kind in kinds:
            check = _CHECKS.get(kind)
            for m in _COMPILED[kind].finditer(text):
                group = 1 if m.re.groups else 0
                if check is None or check(m[group]):
                    found.append((m.start(group), place, m.end(group), kind))
    out, last = [], 0
    for start, _, end, kind in sorted(found):
        if start >= last:
            out.append((kind, start, end, text[start:end]))
            last = end
    return out


def replaced(text: str, kinds: tuple[str, ...] = tuple(KINDS)) -> str:
    parts, last = [], 0
    for kind, start, end, _ in find(text, kinds):
        parts += text[last:start], f"[{KINDS[kind][0]}]"
        last = end
    return "".join(parts) + text[last:]


def _each(f, kind: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else f(t))

    return F.pandas_udf(run, kind)


def spans(text: Column, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """Disjoint spans of whole texts, of any length, in code points: overlaps need order, so this runs in Arrow batches."""
    row = lambda t: [{"kind": k, "start": a, "end": b, "value": v} for k, a, b, v in find(t, kinds)]
    return _each(row, SPAN)(text)


def redact(text: Column, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """Each span as its kind's label in brackets."""
    return _each(lambda t: replaced(t, kinds), "string")(text)
