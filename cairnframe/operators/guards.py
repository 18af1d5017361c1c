"""Errors as a column: each guard is a chain of conditions of which the first that holds names the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BROKEN, CLONE, EXT_SEALED, FULL
from ..functions.scalars import col


def first_error(*rules: tuple[Column, str]) -> Column:
    out = None
    for condition, name in rules:
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return out


def read_guard(state) -> Column:
    s = col(state)
    return first_error((s == BROKEN, "ExtentBroken"), (s == CLONE, "ExtentClone"))


def write_guard(state, is_clone=False) -> Column:
    """Ordinary writes stay out of an extent that is being cloned; a clone's writes need one that is."""
    s, c = col(state), col(is_clone)
    return first_error((s == BROKEN, "ExtentBroken"), (s == FULL, "ExtentFull"), (s == EXT_SEALED, "ExtentSealed"), ((s == CLONE) & ~c, "ExtentClone"), ((s != CLONE) & c, "ExtentNotClone"))


def modify_guard(state) -> Column:
    return first_error((col(state) == BROKEN, "ExtentBroken"))


def request_guard(requests: DataFrame, extents: DataFrame, disks: DataFrame, server_state: str, group_id: int, closed: bool = False) -> DataFrame:
    """``requests`` (with ext_id, group_id) and their err.

    ``extents`` has ext_id, state, disk_id; ``disks`` disk_id, state.  The tables of disks is joined to the extents first, so that
    requests are joined once.  A broken disk is reported as such.
    """
    from .joins import join_dimension

    known = join_dimension(extents.select("ext_id", F.col("state").alias("ext_state"), "disk_id"), disks.select("disk_id", F.col("state").alias("disk_state")), "disk_id", "left")
    out = join_dimension(requests, known.select("ext_id", "ext_state", "disk_state"), "ext_id", "left")
    err = first_error(
        (F.lit(closed), "ServiceClosed"),
        (F.lit(server_state) == "Tombstone", "ServerTombstone"),
        (F.col("group_id") != group_id, "BadRequest"),
        (F.col("ext_state").isNull(), "NotFound"),
        (F.col("ext_state") == BROKEN, "ExtentBroken"),
        (F.col("disk_state") == "Broken", "DiskBroken"),
        (F.col("disk_state") == "Tombstone", "DiskTombstone"),
    )
    return out.withColumn("err", err).drop("ext_state", "disk_state")


def header_error(oid, magic_ok, crc_ok) -> Column:
    return first_error((col(oid) == 0, "ErrUnwritten"), (~col(magic_ok), "ErrMagic"), (~col(crc_ok), "ErrChecksum"))


def misdirected(hdr_ext_id, ext_id, hdr_offset, offset) -> Column:
    """Whether a record says that it belongs elsewhere."""
    return (col(hdr_ext_id) != col(ext_id)) | (col(hdr_offset) != col(offset))


def cycle_error(record_cycle, segment_cycle) -> Column:
    return first_error((col(record_cycle) < col(segment_cycle), "End"), (col(record_cycle) > col(segment_cycle), "ExtentBroken"))


def state_after(state, err) -> Column:
    """What an error does to an extent's state."""
    return F.when(col(err) == "DiskBroken", F.lit(BROKEN)).when(col(err) == "ExtentBroken", F.lit(BROKEN)).when((col(err) == "ExtentFull") & (col(state) != BROKEN), F.lit(FULL)).otherwise(col(state))


def snapshot_behind(history_next, snap_idx) -> Column:
    """Whether one more segment would overwrite history that no snapshot covers."""
    return col(history_next) - 256 >= col(snap_idx)


def snapshot_caught_up(pairs: list[tuple]) -> Column:
    """Whether a snapshot has the collector's position: all pairs equal, nulls included."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & col(a).eqNullSafe(col(b))
    return out
