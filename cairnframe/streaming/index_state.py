"""The ordered update log as a stream: index state per key, and micro-batches applied to the catalogue.

Each key (ext_id, digest) has a few numbers of state, kept by Spark's state store and checkpointed with the offsets, so a hot extent
is spread over all partitions by its keys.  Rows of one key are applied in order of ``seq`` inside a micro-batch; the source must keep
a key's order between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OP_LOG = "ext_id long, seq long, op string, digest long, new_addr long"
STATE = "present boolean, addr long, n_put long, n_rejected long, n_deleted long, n_moved long, n_missing long"
RESULT = "ext_id long, digest long, " + STATE


def _apply(state: tuple, op: str, addr: int) -> tuple:
    present, at, put, rejected, deleted, moved, missing = state
    if op == "put":
        return (True, at, put, rejected + 1, deleted, moved, missing) if present else (True, addr, put + 1, rejected, deleted, moved, missing)
    if op in ("delete", "readdress") and not present:
        return (present, at, put, rejected, deleted, moved, missing + 1)
    if op == "delete":
        return (False, at, put, rejected, deleted + 1, moved, missing)
    if op == "readdress":
        return (True, addr, put, rejected, deleted, moved + 1, missing)
    return state


def index_state(ops: DataFrame) -> DataFrame:
    """After every micro-batch the state of each key that it touched (update mode); :data:`RESULT`.

    ``addr`` is the last address, whether the key is present or not.
    """

    def run(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        now = state.get if state.exists else (False, 0, 0, 0, 0, 0, 0)
        rows = [r for f in frames for r in zip(f["seq"], f["op"], f["new_addr"], strict=True)]
        for _, op, addr in sorted(rows, key=lambda r: r[0]):
            now = _apply(tuple(now), op, 0 if pd.isna(addr) else int(addr))
        state.update(tuple(now))
        yield pd.DataFrame([(*key, *now)], columns=["ext_id", "digest", "present", "addr", "n_put", "n_rejected", "n_deleted", "n_moved", "n_missing"])

    keyed = ops.where("op IN ('put', 'delete', 'readdress')").groupBy("ext_id", "digest")
    return keyed.applyInPandasWithState(run, RESULT, STATE, "update", "NoTimeout")


def start(ops: DataFrame, out: str, checkpoint: str):
    """Run over all that the source has now; each micro-batch writes the states it changed under ``out``, tagged with its number."""

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={n:012d}")

    return index_state(ops).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark, out: str) -> DataFrame:
    """The last state of every key under ``out``; no address for those that are not present."""
    rows = spark.read.schema(RESULT + ", batch long").parquet(f"{out}/batch=*")
    rest = [c for c in rows.columns if c not in ("ext_id", "digest", "batch")]
    return rows.groupBy("ext_id", "digest").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("ext_id", "digest", "r.*").withColumn("addr", F.when(F.col("present"), F.col("addr")))


def batch_state(ops: DataFrame) -> DataFrame:
    """The same result for a bounded table, in pure SQL functions: ordered windows per key."""
    from pyspark.sql import Window

    w = Window.partitionBy("ext_id", "digest").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    some = ops.where("op IN ('put', 'delete', 'readdress')")
    was = F.coalesce(F.last(F.when(F.col("op").isin("put", "delete"), F.col("op")), ignorenulls=True).over(before) == "put", F.lit(False))
    rows = some.withColumn("was", was)
    put, gone, move = (F.col("op") == x for x in ("put", "delete", "readdress"))
    seq = F.when((put & ~F.col("was")) | (move & F.col("was")), F.col("seq"))
    agg = rows.groupBy("ext_id", "digest").agg(
        F.coalesce(F.max_by(put, F.when(put | gone, F.col("seq"))), F.lit(False)).alias("present"),
        F.max_by("new_addr", seq).alias("addr"),
        F.count_if(put & ~F.col("was")).alias("n_put"),
        F.count_if(put & F.col("was")).alias("n_rejected"),
        F.count_if(gone & F.col("was")).alias("n_deleted"),
        F.count_if(move & F.col("was")).alias("n_moved"),
        F.count_if(~put & ~F.col("was")).alias("n_missing"),
    )
    return agg.withColumn("addr", F.when(F.col("present"), F.col("addr")))
