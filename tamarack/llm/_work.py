"""Tables that an operator writes on its way, in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one of this machine only where that is unset and the master is local (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        top = "file://" + tempfile.mkdtemp(prefix="tamarack-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/tamarack-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stash(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove what ``stash`` wrote, through Hadoop's file system so that any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # the session ended first
            return
