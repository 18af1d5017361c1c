"""Next-fit placement of objects in the segments of their extents.

Placement is an ordered fold: an object that does not fit in what is left of the segment opens the next ready one.  Extents are
independent, so rows are dealt out by extent and sorted by sequence number; a task then streams over its Arrow batches with one
extent's (segment, cursor) as its only state.  Memory is bounded by a batch whatever an extent holds.  Inside a batch the fold
takes one binary search in the running sizes per *segment*, not a step per object.

Extents that are not fresh send a row of their own ahead of their objects (``kind`` 0) with where they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExtentConfig
from ..functions import scalars as s

FRESH = "ext_id long, seg long, cur long, history_next long, snap_idx long, ready array<int>"
_CARRIED = ("seq", "digest", "grains", "otype")
_OUT = "ext_id long, seq long, digest long, grains long, otype smallint, seg long, cur long, history_idx long, err string"


class _Extent:
    """Where an extent stands; ``place`` gives (segment, cursor, history index, error) for objects in order."""

    def __init__(self, segment_size: int, ready: list[int], seg: int = 0, cur: int = 0, history: int = 0, snap_idx: int = 0):
        self.size, self.ready, self.seg, self.cur, self.history, self.snap_idx = segment_size, list(ready), seg, cur, history, snap_idx
        self.err: str | None = None

    def place(self, mov, seg, cur, history, err) -> None:
        """Fill the output arrays for aligned sizes ``mov``."""
        import numpy as np

        total = np.concatenate([[0], np.cumsum(mov)])
        at, n = 0, mov.size
        while at < n and self.err is None:
            end = int(np.searchsorted(total, total[at] + self.size - self.cur, side="right")) - 1
            if end > at:
                seg[at:end], history[at:end] = self.seg, self.history
                cur[at:end] = self.cur + total[at:end] - total[at]
                self.cur += int(total[end] - total[at])
                at = end
            if at < n:
                if self.history + 1 - 256 >= self.snap_idx:  # the ring would overwrite what no snapshot has
                    self.err = "ExtentBroken"
                elif not self.ready:
                    self.err = "ExtentFull"
                else:
                    self.seg, self.cur, self.history = self.ready.pop(0), 0, self.history + 1
        err[at:] = self.err


def place(puts: DataFrame, config: ExtentConfig, states: DataFrame | None = None) -> DataFrame:
    """Segment, cursor, history index and address of every object, or the error that refuses it.

    ``puts`` has ext_id, seq, digest, grains, otype; ``states`` (:data:`FRESH`) says where extents stand that are not fresh.  Objects
    over a segment are refused and move nothing.
    """
    size, fresh = config.segment_size, list(range(1, config.usable_segments))
    objects = puts.select(F.col("ext_id").cast("long").alias("ext_id"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("digest").cast("long").alias("digest"), F.col("grains").cast("long").alias("grains"), F.col("otype").cast("smallint").alias("otype"), F.lit(None).cast("struct<seg:long,cur:long,history_next:long,snap_idx:long,ready:array<int>>").alias("state"))
    rows = objects
    if states is not None:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(_CARRIED, ("long", "long", "long", "smallint"), strict=True)]
        rows = states.select("ext_id", F.lit(0).alias("kind"), *nothing, F.struct("seg", "cur", "history_next", "snap_idx", "ready").alias("state")).unionByName(objects)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ext, held = None, None
        kind = pa.schema([("ext_id", pa.int64()), ("seq", pa.int64()), ("digest", pa.int64()), ("grains", pa.int64()), ("otype", pa.int16()), ("seg", pa.int64()), ("cur", pa.int64()), ("history_idx", pa.int64()), ("err", pa.string())])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("ext_id").to_numpy(zero_copy_only=False)
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            grains = batch.column("grains").fill_null(0).to_numpy(zero_copy_only=False)
            mov = -(-(4096 + grains * 4096) // 16384) * 16384
            seg, cur, history = (np.full(n, -1, dtype=np.int64) for _ in range(3))
            err = np.full(n, None, dtype=object)
            starts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                if kinds[a] == 0:
                    x = batch.column("state")[b - 1].as_py()
                    held, ext = int(ids[a]), _Extent(size, x["ready"], x["seg"], x["cur"], x["history_next"] - 1, x["snap_idx"])
                    continue
                if held != ids[a]:
                    held, ext = int(ids[a]), _Extent(size, fresh)
                large = mov[a:b] > size
                err[a:b][large] = "ObjectTooLarge"
                fit = np.flatnonzero(~large) + a
                out = [x[fit] for x in (seg, cur, history, err)]
                ext.place(mov[fit], *out)
                for x, y in zip((seg, cur, history, err), out, strict=True):
                    x[fit] = y
            keep = pa.array(kinds == 1)
            placed = pa.array(seg < 0)
            arrays = [batch.column("ext_id"), *(batch.column(c) for c in _CARRIED), *(pc.if_else(placed, None, pa.array(x)) for x in (seg, cur, history)), pa.array(err, pa.string())]
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, kind.types, strict=True)], schema=kind).filter(keep)

    folded = rows.repartition("ext_id").sortWithinPartitions("ext_id", "kind", "seq").mapInArrow(run, _OUT)
    return folded.withColumn("addr", F.when(F.col("err").isNull(), s.addr_of("seg", "cur", size)))
