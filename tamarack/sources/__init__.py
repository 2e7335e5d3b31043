"""Sources: the driver's tables, text payloads and call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One call of the log: what was done to which format, tokens before and after, and how long it took.
CALL_LOG = "action string, format string, input_tokens long, output_tokens long, saved_tokens long, percent int, reversible boolean, timestamp long, duration_ms double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as documents: ``path, text``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """An append-only log, one JSON object a line; lines that don't parse are dropped."""
    return spark.read.schema(CALL_LOG).option("mode", "DROPMALFORMED").json(path)


def events_as_calls(events: DataFrame) -> DataFrame:
    """The event table seen as a call log: type as format, value as milliseconds, the id's remainder as action."""
    return events.select(
        F.when(F.col("event_id") % 4 == 0, "decompress").otherwise("compress").alias("action"),
        F.col("event_type").alias("format"),
        (F.col("event_id") % 1000 + 100).alias("input_tokens"),
        (F.col("event_id") % 700 + 50).alias("output_tokens"),
        (F.col("event_id") % 5 != 0).alias("reversible"),
        F.col("user_id"),
        F.col("ts"),
        F.col("value").alias("duration_ms"),
    )
