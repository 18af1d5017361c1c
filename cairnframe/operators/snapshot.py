"""Index snapshots: immutable versions of the index, found by a manifest row that is written last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s

COST_LIMIT = 2.0


def latest(manifest: DataFrame) -> DataFrame:
    """The manifest row of each extent's newest snapshot."""
    rest = [c for c in manifest.columns if c not in ("ext_id", "snap_ts")]
    best = manifest.groupBy("ext_id").agg(F.max("snap_ts").alias("snap_ts"), F.max_by(F.struct(*rest), "snap_ts").alias("r"))
    return best.select("ext_id", "snap_ts", "r.*")


def superseded(manifest: DataFrame) -> DataFrame:
    """ext_id, snap_ts of the snapshots that retention may drop."""
    newest = manifest.groupBy("ext_id").agg(F.max("snap_ts").alias("newest"))
    return manifest.join(newest, "ext_id").where("snap_ts < newest").select("ext_id", "snap_ts")


def sizes(index: DataFrame) -> DataFrame:
    """ext_id, obj_cnt, blocks, n_bytes of a snapshot of each extent."""
    n = index.groupBy("ext_id").agg(F.count("*").alias("obj_cnt"))
    return n.select("ext_id", "obj_cnt", s.snap_blocks("obj_cnt").alias("blocks"), s.snap_bytes("obj_cnt").alias("n_bytes"))


def worth_writing(n_bytes, age_ms, last_exists=True):
    """Whether the cost gate lets a snapshot be written now; the first always is."""
    return ~s.col(last_exists) | (s.snap_cost(n_bytes, age_ms) < COST_LIMIT)


def deduplicated(entries: DataFrame) -> DataFrame:
    """Entries of all tables of a snapshot, each key once: the first read wins where ``table`` says which came first."""
    rest = [c for c in entries.columns if c not in ("ext_id", "digest")]
    order = F.col("table") if "table" in entries.columns else F.col("addr")
    return entries.groupBy("ext_id", "digest").agg(F.min_by(F.struct(*rest), order).alias("r")).select("ext_id", "digest", "r.*")
