"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of at most this many rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where one machine is all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cairnframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh place for a table in the shared folder."""
    return f"{shared_dir(spark)}/cairnframe-scratch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "scratch", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced, before the next large shuffle.

    Python's references reach the JVM's collector, and its weak references the cleaner, one after the other: hence rounds.
    """
    import gc
    import time

    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually small.

    ``small`` is counted first (it should be cheap or materialised): up to ``rows`` rows it is broadcast, beyond that the
    join is left to the planner, which shuffles both sides and splits skewed partitions.
    """
    if small.limit(rows + 1).count() <= rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body`` (a one-element transform binds it to a variable)."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(df: DataFrame, default: int | None = None) -> int:
    return default or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
