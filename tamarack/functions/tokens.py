"""Token counts, by an estimate or by a byte-pair vocabulary whose file is named; what savings are worth; where prefixes can be cached."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions import lossy
from tamarack.functions.codec import HEADER

# Seconds for which each target keeps a prefix.
TTL = {"default": 300, "long": 3600, "none": 0, "session": 0}
# Bytes a token, tokens from which a prefix pays, breakpoints of one request.
BYTES, LEAST, LEAST_KEYED, MOST_BREAKPOINTS = 4, 4096, 1024, 4
_SPLIT = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""

Counter = Callable[[str], int]
_factories: list[Callable[[str], Counter | None]] = []


def estimate(text: str) -> int:
    """A quarter of the code points, rounded up, at least 1."""
    return max(1, -(-len(text) // 4))


def register(factory: Callable[[str], Counter | None]) -> None:
    """A factory gives a model's counter, or None; the newest is asked first."""
    _factories.insert(0, factory)


def resolve(model: str) -> Counter:
    return next((c for f in _factories if (c := f(model))), estimate)


@functools.cache
def bpe(path: str) -> Counter:
    """Counts by a vocabulary file of base64 tokens and ranks; loaded once a process."""
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    encoding = tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def counted(text: Column, vocabulary: str | None = None, model: str = "") -> Column:
    """Tokens by the vocabulary file if one is named, else by the model's counter; null of null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = bpe(vocabulary) if vocabulary else chosen
        for s in batches:
            yield s.map(lambda x: None if x is None else count(x)).astype("Int64")

    chosen = resolve(model)
    return F.pandas_udf(run, "long")(text)


def savings(before: Column, after: Column, usd_in: Column, usd_out: Column) -> Column:
    """``saved, percent, usd_in, usd_out`` of token counts and prices for a million tokens; halves are rounded up."""
    saved = before - after
    percent = F.when(before > 0, F.floor(100 * saved / before + 0.5)).otherwise(0).cast("long")
    cost = lambda usd: saved * usd / 1_000_000
    return F.struct(saved.alias("saved"), percent.alias("percent"), cost(usd_in).alias("usd_in"), cost(usd_out).alias("usd_out"))


def prefix_bytes(text: str) -> int:
    """Bytes of a compact text's headers and dictionary, which calls share; 0 for another text."""
    if not text.startswith(HEADER.split()[0] + " "):
        return 0
    at, inside = 0, False
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        inside = inside and bare != "@end" or bare == "@dict"
        if not (inside or bare.startswith("@") or not bare):
            break
        at += len(line.encode())
    return at


def cache_breakpoint(text: Column, target: str = "default") -> Column:
    """``bytes, seconds``: where the shared prefix ends and how long it is kept."""
    size = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else prefix_bytes(x)).astype("Int64"), "long")(text)
    return F.struct(size.alias("bytes"), F.lit(TTL.get(target, 0)).alias("seconds"))


def breakpoints(prefixes: Column) -> Column:
    """Of an array of prefix sizes in bytes those that pay for a breakpoint, the largest first."""
    return F.slice(F.reverse(F.array_sort(F.filter(prefixes, lambda b: b / BYTES >= LEAST))), 1, MOST_BREAKPOINTS)


def cache_key(prefix: Column) -> Column:
    """The first 16 digits of a prefix's digest where it is long enough to be cached; else null."""
    return F.when(F.octet_length(prefix) / BYTES >= LEAST_KEYED, F.substring(F.sha2(prefix, 256), 1, 16))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def family(model: Column) -> Column:
    return lossy.tokenizer_family(model)


def clamp(text: Column, most: int = 1 << 20) -> Column:
    """The last ``most`` characters of a tool's result."""
    return F.when(F.length(text) > most, F.substring(text, F.length(text) - most + 1, F.lit(most))).otherwise(text)


def passes(tool: Column, patterns: list[str]) -> Column:
    """Whether a tool's name is a pattern or begins as one that ends in ``*``."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (tool.startswith(p[:-1]) if p.endswith("*") else tool == p)
    return hit


def words(text: str) -> list[str]:
    return re.split(r"[ \t\n\r]+", text)
