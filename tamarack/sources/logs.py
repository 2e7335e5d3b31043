"""Session logs: one JSON object a line, tagged h (header), r (record), f (footer) or d (a day's sums)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fields of all kinds of lines, and the bytes of a log that is read at most by ``folder``.
LINE = "t string, sessionId string, agent string, project string, startedAt long, endedAt long, action string, format string, inputTokens long, outputTokens long, savedTokens long, savingsPercent long, reversible boolean, timestamp long, durationMs double, date string, calls long"
LARGEST = 8 << 20
_ACTIONS = ("compress", "decompress")


def lines(raw: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "line") -> DataFrame:
    """``file, line_no`` and a line's fields, from lines of text; lines that don't parse or have no known tag are dropped."""
    parsed = raw.select(F.col(file).alias("file"), F.col(line_no).alias("line_no"), F.from_json(F.col(text), LINE).alias("x")).select("file", "line_no", "x.*")
    return parsed.where(F.col("t").isin("h", "r", "f", "d"))


def folder(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """``file, line_no, line`` of a folder's ``*.jsonl`` files of up to ``largest`` bytes."""
    raw = spark.read.option("pathGlobFilter", "*.jsonl").text(path).where(F.col("_metadata.file_size") <= largest)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id")).alias("line_no"), F.col("value").alias("line"))
    return raw


def sessions(log: DataFrame) -> DataFrame:
    """By file: its last header's and footer's fields and the number of records; one combined aggregate."""
    last = lambda tag, *fields: F.max_by(F.when(F.col("t") == tag, F.struct(*fields)), F.when(F.col("t") == tag, F.col("line_no")))
    out = log.groupBy("file").agg(last("h", "sessionId", "agent", "project", "startedAt").alias("header"), last("f", "endedAt").alias("footer"), F.count_if(F.col("t") == "r").alias("records"))
    return out.select("file", "header.*", F.col("footer.endedAt").alias("endedAt"), F.col("header").isNotNull().alias("has_header"), F.col("footer").isNotNull().alias("closed"), "records")


def active(log: DataFrame) -> DataFrame:
    """Sessions with a header and no footer."""
    return sessions(log).where("has_header and not closed")


def records(log: DataFrame, since: int | None = None, agent: str | None = None, project: str | None = None, active_only: bool = False) -> DataFrame:
    """Calls, a day's sums as one record of ``calls`` calls. Files without a header pass the filters by agent and project.

    Missing fields get defaults, as does a negative or infinite duration; records of an unknown action are dropped.
    """
    rec = log.where(F.col("t").isin("r", "d")).select(
        "file", F.coalesce("action", F.lit("compress")).alias("action"), F.coalesce("format", F.lit("unknown")).alias("format"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("inputTokens", "outputTokens", "savedTokens")],
        F.coalesce("reversible", F.lit(True)).alias("reversible"),
        F.coalesce("timestamp", F.unix_millis(F.to_timestamp("date")), F.lit(0).cast("long")).alias("timestamp"),
        F.when((F.col("durationMs") >= 0) & (F.col("durationMs") < float("inf")), F.col("durationMs")).otherwise(0.0).alias("durationMs"),
        F.when(F.col("t") == "d", F.coalesce("calls", F.lit(0).cast("long"))).otherwise(1).cast("long").alias("calls"),
    )
    rec = rec.where(F.col("action").isin(*_ACTIONS))
    if since is not None:
        rec = rec.where(F.col("timestamp") >= since)
    if agent is None and project is None and not active_only:
        return rec
    s = sessions(log)
    ok = F.lit(True)
    if agent is not None:
        ok &= ~F.col("has_header") | (F.col("agent") == agent)
    if project is not None:
        ok &= ~F.col("has_header") | (F.col("project") == project)
    if active_only:
        ok &= F.col("has_header") & ~F.col("closed")
    return rec.join(s.where(ok).select("file"), "file", "left_semi")


def project_stats(log: DataFrame) -> DataFrame:
    """By project, and over all as null: calls and tokens. One aggregate of the records by file, then the headers."""
    per = records(log).groupBy("file").agg(F.sum("calls").alias("calls"), F.sum("inputTokens").alias("input"), F.sum("outputTokens").alias("output"))
    named = per.join(sessions(log).select("file", F.coalesce("project", F.lit("unknown")).alias("project")), "file")
    return named.rollup("project").agg(F.sum("calls").alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"))


def compacted(log: DataFrame, now: int, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sums to append to the archive, lines that stay): closed sessions begun over ``days`` before ``now`` become sums by UTC day and format."""
    old = sessions(log).where(F.col("closed") & F.col("has_header") & (F.col("startedAt") < now - days * 86_400_000)).select("file")
    gone = records(log).join(old, "file", "left_semi").withColumn("date", F.to_date(F.timestamp_millis("timestamp")).cast("string"))
    sums = gone.groupBy("date", "format").agg(F.sum("calls").alias("calls"), *[F.sum(c).alias(c) for c in ("inputTokens", "outputTokens", "savedTokens")])
    return sums.select(F.lit("d").alias("t"), "*"), log.join(old, "file", "left_anti")


def append(rows: DataFrame, path: str) -> None:
    """Lines to a log; null fields are left out."""
    rows.write.mode("append").json(path)


def header(spark: SparkSession, session: str, agent: str, project: str, at: int) -> DataFrame:
    return spark.createDataFrame([("h", session, agent, project, at)], "t string, sessionId string, agent string, project string, startedAt long")


def footer(spark: SparkSession, session: str, at: int) -> DataFrame:
    return spark.createDataFrame([("f", session, at)], "t string, sessionId string, endedAt long")


def reset(spark: SparkSession, path: str) -> None:
    """An empty store in place of what the path holds."""
    spark.createDataFrame([], LINE).write.mode("overwrite").json(path)


def last_days(log: DataFrame, now: int, days: int = 7) -> DataFrame:
    """The last ``days`` times 24 hours up to ``now``."""
    return records(log, since=now - days * 86_400_000)


#: The history of results: what a table of them holds.
HISTORY = "id long, timestamp long, input string, output string, format string, saved_tokens long"


def newest(history: DataFrame, keep: int = 100) -> DataFrame:
    """What a history retains."""
    return history.orderBy(F.desc("timestamp"), F.desc("id")).limit(keep)


def by_line(df: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """``file, line_no, line`` of a table that holds lines in order."""
    return df.select(F.col(file).alias("file"), F.row_number().over(Window.partitionBy(file).orderBy(order)).alias("line_no"), F.col(text).alias("line"))
