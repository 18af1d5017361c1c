"""Garbage: what deletes leave behind, which segments are worth collecting, and their compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FULL, GRAIN, READ_WRITE, READY, RESERVED, SEALED, SEGMENTS, WRITABLE, ExtentConfig
from ..functions import scalars as s
from .placement import place


def removed_by_segment(index: DataFrame, deletes: DataFrame, segment_size: int) -> DataFrame:
    """ext_id, seg, removed: grains that deleted keys occupied.  Keys not in the index do not count."""
    gone = index.join(deletes.select("ext_id", "digest").distinct(), ["ext_id", "digest"], "left_semi")
    return gone.groupBy("ext_id", s.addr_to_seg("addr", segment_size).alias("seg")).agg(F.sum(s.moved_grains("grains")).alias("removed"))


def used_by_segment(index: DataFrame, segment_size: int) -> DataFrame:
    """ext_id, seg, used: grains that live keys occupy, each key once."""
    once = index.select("ext_id", "digest", "grains", "addr").dropDuplicates(["ext_id", "digest"])
    return once.groupBy("ext_id", s.addr_to_seg("addr", segment_size).alias("seg")).agg(F.sum(s.moved_grains("grains")).alias("used"))


def deep_removed(segments: DataFrame, index: DataFrame, segment_size: int) -> DataFrame:
    """ext_id, seg, used, removed of sealed segments, counted from the index alone; both in grains."""
    sealed = segments.where(F.col("state") == SEALED).select("ext_id", "seg")
    out = sealed.join(used_by_segment(index, segment_size), ["ext_id", "seg"], "left")
    used = F.coalesce("used", F.lit(0).cast("long"))
    return out.select("ext_id", "seg", used.alias("used"), (segment_size // GRAIN - used).alias("removed"))


def segment_table(index: DataFrame, config: ExtentConfig, removed: DataFrame | None = None) -> DataFrame:
    """All 256 segments of every extent that ``index`` (with seg, history_idx and seq) has rows of.

    The last segment of the history is writable, the others in it are sealed; the sealed time is the last seq in it.
    """
    used = index.groupBy("ext_id", "seg").agg(F.max("seq").alias("sealed_hours"), F.max("history_idx").alias("history_idx"))
    last = used.groupBy("ext_id").agg(F.max("history_idx").alias("last_idx"))
    every = last.select("ext_id", "last_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SEGMENTS - 1).cast("long"))).alias("seg"))
    out = every.join(used, ["ext_id", "seg"], "left")
    state = F.when(F.col("history_idx") == F.col("last_idx"), WRITABLE).when(F.col("history_idx").isNotNull(), SEALED).when(F.col("seg") >= config.usable_segments, RESERVED).otherwise(READY)
    out = out.select("ext_id", "seg", state.alias("state"), "sealed_hours", "history_idx", "last_idx")
    if removed is not None:
        out = out.join(removed, ["ext_id", "seg"], "left").withColumn("removed", F.coalesce("removed", F.lit(0).cast("long")))
    return out


def candidates(segments: DataFrame, ratio: float, segment_size: int, unsnapped: DataFrame | None = None, unfinished: DataFrame | None = None) -> DataFrame:
    """ext_id, seg, removed, sealed_hours, rank: sealed segments worth collecting, most garbage first, then oldest.

    Segments in ``unsnapped`` (ext_id, seg: history that no snapshot covers) wait.  A source in ``unfinished`` comes first whatever
    it holds.  Ranks are per extent, over at most 256 rows.
    """
    least = int(segment_size // GRAIN * ratio)
    ok = segments.where((F.col("state") == SEALED) & (F.col("removed") >= least))
    if unsnapped is not None:
        ok = ok.join(unsnapped.select("ext_id", "seg"), ["ext_id", "seg"], "left_anti")
    ok = ok.select("ext_id", "seg", "removed", "sealed_hours")
    if unfinished is not None:
        ok = ok.join(unfinished.select("ext_id", "seg"), ["ext_id", "seg"], "left_anti")
        ok = ok.unionByName(unfinished.select("ext_id", "seg", F.lit(segment_size // GRAIN).cast("long").alias("removed"), F.lit(0).cast("long").alias("sealed_hours")))
    order = Window.partitionBy("ext_id").orderBy(F.col("removed").desc(), "sealed_hours", "seg")
    return ok.withColumn("rank", F.row_number().over(order).cast("long"))


def compact(index: DataFrame, sources: DataFrame, config: ExtentConfig, reserve: DataFrame | None = None) -> DataFrame:
    """New places of the live objects in ``sources`` (ext_id, seg, rank): ext_id, digest, grains, otype, addr, new_seg, new_addr.

    Live objects go next-fit, in the order of the sources and of their addresses, to the reserved segment (``reserve``: ext_id, seg;
    without it the last one), then to the sources in the order in which they fall free.  (All that is left of a source fits in a segment, so a source is never opened too early.)
    """
    size = config.segment_size
    live = index.withColumn("seg", s.addr_to_seg("addr", size)).join(sources.select("ext_id", "seg", "rank"), ["ext_id", "seg"])
    seq = F.col("rank") * (1 << 24) + F.col("addr")
    puts = live.select("ext_id", seq.alias("seq"), "digest", "grains", "otype")
    free = sources.groupBy("ext_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("seg").cast("int").alias("seg")))), lambda x: x["seg"]).alias("ready"))
    zero = F.lit(0).cast("long")
    first = free.join(reserve.select("ext_id", F.col("seg").cast("long").alias("dst")), "ext_id") if reserve is not None else free.withColumn("dst", F.lit(SEGMENTS - 1).cast("long"))
    states = first.select("ext_id", F.col("dst").alias("seg"), zero.alias("cur"), F.lit(1).cast("long").alias("history_next"), zero.alias("snap_idx"), "ready")
    placed = place(puts, config, states)
    return placed.select("ext_id", "digest", "grains", "otype", (F.col("seq") % (1 << 24)).alias("addr"), F.col("seg").alias("new_seg"), F.col("addr").alias("new_addr"))


def source_done(sources: DataFrame, reserve: DataFrame, config: ExtentConfig) -> DataFrame:
    """What a collected source becomes: its state, cycle, and the bytes its extent gains.

    ``reserve`` has ext_id and n_reserved; the source joins the reserve until that has more than ``reserved_seg`` segments, counted
    with the sources ranked before it.
    """
    out = sources.join(reserve, "ext_id", "left")
    ready = F.coalesce("n_reserved", F.lit(0)) + F.col("rank") - 1 > config.reserved_seg - 1
    return out.select(
        "ext_id",
        "seg",
        F.when(ready, READY).otherwise(RESERVED).alias("state"),
        (F.coalesce("cycle", F.lit(0)) + 1).cast("long").alias("cycle"),
        F.lit(0).cast("long").alias("removed"),
        F.when(ready, F.lit(config.segment_size)).otherwise(F.lit(0)).cast("long").alias("gained"),
    )


def reopened(state: Column, gained: Column) -> Column:
    """A full extent that gains space takes writes again."""
    return F.when((state == FULL) & (gained > 0), F.lit(READ_WRITE)).otherwise(state)


def state_counts(segments: DataFrame, segment_size: int) -> DataFrame:
    """Per extent the segments in each state, and the bytes available."""
    counts = [F.count_if(F.col("state") == x).alias("n_" + x.lower()) for x in (READY, RESERVED, WRITABLE, SEALED)]
    return segments.groupBy("ext_id").agg(*counts).withColumn("avail", F.col("n_ready") * segment_size)


def next_segment(segments: DataFrame, state: str = READY) -> DataFrame:
    """ext_id, seg: the lowest segment in a state."""
    return segments.where(F.col("state") == state).groupBy("ext_id").agg(F.min("seg").alias("seg"))


def reserve_enough(segments: DataFrame, config: ExtentConfig) -> DataFrame:
    return segments.groupBy("ext_id").agg(F.count_if(F.col("state") == RESERVED).alias("n")).select("ext_id", (F.col("n") > config.reserved_seg).alias("enough"))
