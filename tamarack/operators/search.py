"""Lines and tools that answer a question."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import texts


def _asked(question: str, stopwords: frozenset[str] = frozenset()) -> list[str]:
    return list(dict.fromkeys(x for x in re.split("[^a-z0-9_]+", question.lower()) if len(x) > 1 and x not in stopwords))


def best_lines(docs: DataFrame, question: str, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, pos, line, score``: each text's ``k`` lines of highest score, earlier first among equals to nine decimals.

    A line's score sums, over the question's words that it holds, ln(1 + n / (1 + d))
    with n lines in the text and d of them with the word. Weights come from the
    text itself, so rows are scored without a shuffle; only lines that score
    are ranked. Sums of different words can be equal but for the last bits, so
    ranking rounds. Null texts have no lines. A question without words finds none.
    """
    asked = _asked(question, texts.STOPWORDS)
    if not asked:
        return docs.select(F.col(id_col).alias("id"), F.lit(0).alias("pos"), F.lit("").alias("line"), F.lit(0.0).alias("score")).limit(0)
    rows = docs.select(F.col(id_col).alias("id"), F.transform(F.split(text_col, "\n"), lambda x: F.struct(x.alias("line"), texts.terms(x).alias("terms"))).alias("lines"))
    holds = lambda q: lambda x: F.array_contains(x["terms"], q)
    with_word = [F.size(F.filter("lines", holds(q))) for q in asked]
    weights = F.array(*[F.log(1 + F.size("lines") / (1 + d)) for d in with_word])
    line = rows.select("id", weights.alias("weights"), F.posexplode("lines").alias("pos", "at"))
    score = sum((F.when(F.array_contains("at.terms", q), F.col("weights")[i]).otherwise(0.0) for i, q in enumerate(asked)), F.lit(0.0))
    scored = line.select("id", "pos", "at.line", score.alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.round("score", 9).desc(), "pos"))
    return scored.withColumn("place", place).where(F.col("place") <= k).drop("place")


def tool_score(name, description, question: str):
    """Three for each word of a tool's name, one of its description, that equals or begins with a word asked for, or begins one of four letters or more."""
    meets = lambda q: lambda x: x.startswith(q) | (F.lit(q).startswith(x) & F.lit(len(q) >= 4))
    hits = lambda c, q: F.size(F.filter(texts.terms(F.coalesce(c, F.lit(""))), meets(q)))
    return sum((3 * hits(name, q) + hits(description, q) for q in _asked_all(question)), F.lit(0)).cast("long")


def _asked_all(question: str) -> list[str]:
    """Words as asked, repeats counted."""
    return [x for x in re.split("[^a-z0-9_]+", question.lower()) if len(x) > 1]


def best_tools(tools: DataFrame, question: str, k: int, name: str, description: str, key: str) -> DataFrame:
    """``key, score`` of the ``k`` tools that score highest, smaller keys first among equals; tools without a hit stay out."""
    scored = tools.select(F.col(key), tool_score(F.col(name), F.col(description), question).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k)
