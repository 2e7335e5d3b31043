"""Running usage statistics and repeats over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.sources import CALL_LOG


def call_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New log files of a folder as a stream, with event time."""
    return spark.readStream.schema(CALL_LOG).json(folder).withColumn("ts", F.timestamp_millis("timestamp"))


def running_stats(calls: DataFrame) -> DataFrame:
    """Calls and savings by format so far; for complete or update output."""
    return calls.groupBy("format").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") - F.col("output_tokens")).alias("saved_tokens"))


def windowed_stats(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls by window of event time; state of windows behind the watermark goes."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", width), "format").agg(F.count(F.lit(1)).alias("calls"))


def first_texts(texts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Texts not seen within the watermark: state is dropped by time, as no least-recently-used order exists across tasks."""
    return texts.withColumn("digest", F.sha2("text", 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["digest"])
