"""What a restart reads: snapshot, log tail in history order, delete log; and the checks on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_OBJECT
from ..functions import scalars as s
from .guards import first_error

KEY = ["ext_id", "digest"]


def gc_truncated(index: DataFrame, gc: DataFrame, segment_size: int) -> DataFrame:
    """The index without what collection had put at or beyond its cursor.

    ``gc`` has ext_id, gc_dst, gc_dst_cur; only the destination segment is cut, later segments are not touched.
    """
    out = index.join(gc.select("ext_id", "gc_dst", "gc_dst_cur"), "ext_id", "left")
    cut = (s.addr_to_seg("addr", segment_size) == F.col("gc_dst")) & (F.col("addr") >= s.addr_of("gc_dst", "gc_dst_cur", segment_size))
    return out.where(~F.coalesce(cut, F.lit(False))).select(*index.columns)


def log_tail(log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Records that the snapshot (ext_id, history_idx, cur) has not seen: later segments, and its own from the cursor on."""
    at = snapshot.select("ext_id", F.col("history_idx").alias("snap_idx"), F.col("cur").alias("snap_cur"))
    rows = log.join(at, "ext_id", "left")
    idx, cur = F.coalesce("snap_idx", F.lit(0)), F.coalesce("snap_cur", F.lit(0))
    return rows.where((F.col("history_idx") > idx) | ((F.col("history_idx") == idx) & (F.col("cur") >= cur))).select(*log.columns)


def live_records(log: DataFrame) -> DataFrame:
    """``log`` (with cycle, seg_cycle) up to the first record of an older cycle in each segment, with err where a newer one comes."""
    first = log.where("cycle < seg_cycle").groupBy("ext_id", "seg").agg(F.min("cur").alias("end"))
    out = log.join(first, ["ext_id", "seg"], "left").where("end IS NULL OR cur < end").drop("end")
    return out.withColumn("err", first_error((F.col("cycle") > F.col("seg_cycle"), "ExtentBroken")))


def segment_ends(log: DataFrame, readable: Column) -> DataFrame:
    """ext_id, seg, history_idx, end (where reading stops), first_bytes (what the first object takes), n_live per segment."""
    moved = s.moved_bytes("grains")
    bad = F.min(F.when(~readable, F.col("cur")))
    return log.groupBy("ext_id", "seg", "history_idx").agg(
        F.coalesce(bad, F.max(F.col("cur") + moved)).alias("end"), F.min_by(moved, "cur").alias("first_bytes")
    )


def lost_writes(ends: DataFrame, segment_size: int, max_object: int = MAX_OBJECT) -> DataFrame:
    """Per segment but the last of its extent: err where reading stopped so early that a write must be missing.

    More room than any object takes, or room for the object that opens the next segment.
    """
    following = Window.partitionBy("ext_id").orderBy("history_idx")
    rows = ends.withColumn("next_bytes", F.lead("first_bytes").over(following)).where("next_bytes IS NOT NULL")
    most = -(-(4096 + max_object) // 16384) * 16384
    err = first_error((segment_size - F.col("end") > most, "LostWrite"), (F.col("end") + F.col("next_bytes") <= segment_size, "ExtentBroken"))
    return rows.select("ext_id", "seg", "end", "next_bytes", err.alias("err"))


def recover(snapshot_index: DataFrame, tail: DataFrame, deletes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """ext_id, digest, addr, grains, otype, origin: snapshot, then the tail (what is there already stays), less the deletes.

    ``deletes`` has ext_id, digest, ts; those before the snapshot's time are in it already.
    """
    old = snapshot_index.select(*KEY, "addr", "grains", "otype", F.lit(0).alias("o"))
    new = tail.select(*KEY, "addr", "grains", "otype", F.lit(1).alias("o"))
    both = old.unionByName(new).groupBy(*KEY).agg(F.min_by(F.struct("addr", "grains", "otype", "o"), F.struct("o", "addr")).alias("r"))
    times = snapshot.select("ext_id", "hlc_ts")
    gone = deletes.join(times, "ext_id", "left").where("hlc_ts IS NULL OR ts >= hlc_ts").select(*KEY).distinct()
    out = both.join(gone, KEY, "left_anti")
    return out.select(*KEY, "r.addr", "r.grains", "r.otype", F.when(F.col("r.o") == 0, "snapshot").otherwise("log").alias("origin"))
