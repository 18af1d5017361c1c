"""Reading and writing the binary files of extents under ``<root>/ext_<id>/``, in parallel, one row per extent or record.

A file that cannot be read is a row with an error, never a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SNAP_ENTRIES_PER_BLOCK
from ..functions.scalars import ext_id_of
from . import records as r

BOOT, HEADER, DELETES, SNAPSHOT = "boot-sector", "header", "dirty-delete-wal", "*.dmu_snap"


def _files(spark: SparkSession, roots: list[str], name: str) -> DataFrame:
    """ext_id, path, content of the named file of every extent under the roots; other folders are passed over."""
    files = spark.read.format("binaryFile").load([f"{x.rstrip('/')}/*/{name}" for x in roots])
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return files.select(ext_id_of(folder).alias("ext_id"), "path", "content").where("ext_id IS NOT NULL")


def _decoded(files: DataFrame, schema: str, decode) -> DataFrame:
    """Rows that ``decode(content)`` yields as tuples; (None ..., error) rows where it raises."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = []
            for ext_id, path, content in zip(f["ext_id"], f["path"], f["content"], strict=True):
                try:
                    rows += [(ext_id, path, *x, None) for x in decode(bytes(content))]
                except (r.BadRecord, ValueError) as e:
                    rows.append((ext_id, path, *[None] * len(names), str(e)))
            yield pd.DataFrame(rows, columns=["ext_id", "path", *names, "err"]).astype(object)

    return files.mapInPandas(run, f"ext_id long, path string, {schema}, err string")


def list_extents(spark: SparkSession, roots: list[str]) -> DataFrame:
    """ext_id, path, version, err of every extent: what its boot sector says."""
    return _decoded(_files(spark, roots, BOOT), "version int", lambda raw: [(r.read_boot_sector(raw),)])


def read_headers(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One row per extent with the arrays of its header; :func:`segments_of` makes rows of them."""

    def decode(raw: bytes):
        h = r.ExtentHeader.unpack(raw)
        return [(h.state, h.seg_size, h.next_idx, h.states, h.sealed, h.history, h.removed, h.cycles)]

    return _decoded(_files(spark, roots, HEADER), "state int, seg_size long, next_idx long, states array<int>, sealed array<long>, history array<int>, removed array<long>, cycles array<long>", decode)


def segments_of(headers: DataFrame) -> DataFrame:
    """ext_id, seg, state, sealed_hours, removed, cycle: one row for each place of the arrays."""
    zipped = F.arrays_zip("states", "sealed", "removed", "cycles")
    return headers.select("ext_id", F.posexplode(zipped).alias("seg", "z")).select("ext_id", F.col("seg").cast("long").alias("seg"), F.col("z.states").alias("state"), F.col("z.sealed").alias("sealed_hours"), F.col("z.removed").alias("removed"), F.col("z.cycles").alias("cycle"))


def read_deletes(spark: SparkSession, roots: list[str]) -> DataFrame:
    """ext_id, ts, kind, digests of every valid chunk."""
    return _decoded(_files(spark, roots, DELETES), "ts long, kind string, digests array<long>", r.read_delete_log)


def read_snapshots(spark: SparkSession, roots: list[str]) -> DataFrame:
    """ext_id, snap_ts, digest, otype, grains, addr of each extent's newest snapshot, each key once."""

    def run(batches: Iterator) -> Iterator:
        """A block at a time, by numpy; no row becomes a Python object."""
        import numpy as np
        import pyarrow as pa

        names = ["ext_id", "path", "snap_ts", "digest", "otype", "grains", "addr", "err"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for ext_id, path, content in zip(*(batch.column(c) for c in ("ext_id", "path", "content")), strict=True):
                raw, ext_id, path = memoryview(content.as_buffer()), ext_id.as_py(), path.as_py()
                try:
                    head = r.SnapshotHeader.unpack(bytes(raw[:4096]))
                    for i in range(head.blocks):
                        body = r.opened_block(bytes(raw[4096 + i * 32768 : 4096 + (i + 1) * 32768]))
                        e = np.frombuffer(body, dtype=np.dtype([("a", "<u8"), ("b", "u1")]))
                        a = e["a"]
                        columns = [a >> np.uint64(32), a >> np.uint64(30) & np.uint64(3), a >> np.uint64(19) & np.uint64(2047), (a & np.uint64(0xFFFF)) << np.uint64(8) | e["b"]]
                        arrays = [pa.array(np.full(e.size, ext_id)), pa.array([path] * e.size, pa.string()), pa.array(np.full(e.size, head.hlc_ts)), *(pa.array(c.astype(np.int64)) for c in columns), pa.nulls(e.size, pa.string())]
                        yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(arrays, kinds, strict=True)], names=names)
                except r.BadRecord as e:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([ext_id, path, None, None, None, None, None, str(e)], kinds, strict=True)], names=names)

    files = _files(spark, roots, SNAPSHOT).withColumn("snap_ts", F.regexp_extract("path", r"([0-9]+)\.dmu_snap$", 1).cast("long"))
    newest = files.groupBy("ext_id").agg(F.max_by("path", "snap_ts").alias("path"))
    rows = files.join(newest, ["ext_id", "path"], "left_semi").select("ext_id", "path", "content").mapInArrow(run, "ext_id long, path string, snap_ts long, digest long, otype int, grains long, addr long, err string")
    return rows.dropDuplicates(["ext_id", "digest"])


def write_extents(extents: DataFrame, root: str, segment_size: int, reserved: int = 1) -> DataFrame:
    """Create the folders of ``extents`` (ext_id, version): boot sector, header, empty delete log, empty snapshot.  Returns ext_id, path."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for f in frames:
            paths = []
            for ext_id, version in zip(f["ext_id"], f["version"], strict=True):
                folder = f"{base}/ext_{ext_id}"
                store.create_dir(folder, recursive=True)
                header = r.ExtentHeader(0, segment_size % (1 << 32), reserved)
                header.states = [2] + [0] * (255 - reserved) + [1] * reserved
                for name, raw in ((HEADER, header.pack()), (DELETES, b"\0" * 4096), ("1.dmu_snap", r.SnapshotHeader(0, 0, 0, 0, -1, -1, 0, 0, 0, 1, 1).pack()), (BOOT, r.boot_sector(int(version)))):
                    with store.open_output_stream(f"{folder}/{name}") as out:  # the boot sector last: without it there is no extent
                        out.write(raw)
                paths.append(folder)
            yield pd.DataFrame({"ext_id": f["ext_id"], "path": paths})

    return extents.select("ext_id", "version").mapInPandas(run, "ext_id long, path string")


OID_BASE = 1 << 40


def pack_oid(digest: int, otype: int) -> int:
    """What an object's header names it by; never zero, which means unwritten."""
    return OID_BASE | digest << 2 | otype


def _put_file(store, path: str, attempt: int, chunks) -> int:
    """Write a file under a name of the attempt and rename it when whole; returns its size."""
    own, size = f"{path}.{attempt}", 0
    with store.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(own, path)
    return size


def _grouped(batches: Iterator, by: tuple[str, ...]) -> Iterator:
    """(key, rows as dicts) for rows that come sorted by the key; rows are streamed, a batch at a time."""
    from itertools import groupby

    rows = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist())
    return groupby(rows, key=lambda row: tuple(row[c] for c in by))


def _written(rows: DataFrame, by: tuple[str, ...], order: str, root: str, name, chunks) -> DataFrame:
    """ext_id, path, n_bytes: one file for each key, its rows streamed in order through ``chunks(key, rows)``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(root)
        attempt = TaskContext.get().taskAttemptId()
        for key, own in _grouped(batches, by):
            path = f"{base}/ext_{key[0]}/{name(key)}"
            store.create_dir(path.rpartition("/")[0], recursive=True)
            n = _put_file(store, path, attempt, chunks(key, own))
            yield pa.RecordBatch.from_pydict({"ext_id": [key[0]], "path": [path], "n_bytes": [n]})

    return rows.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, "ext_id long, path string, n_bytes long")


def write_segments(log: DataFrame, root: str) -> DataFrame:
    """Append-only segment files of ``log`` (ext_id, seg, cur, digest, otype, grains, cycle, payload): records at their cursors."""

    def chunks(key, rows):
        at = 0
        for x in rows:
            if x["cur"] > at:
                yield bytes(x["cur"] - at)
            record = r.object_record(r.ObjectHeader(pack_oid(x["digest"], x["otype"]), x["grains"], x["cycle"], key[0], x["cur"]), bytes(x["payload"]))
            yield record
            at = x["cur"] + len(record)

    some = log.select("ext_id", "seg", "cur", "digest", "otype", "grains", "cycle", "payload")
    return _written(some, ("ext_id", "seg"), "cur", root, lambda key: f"segment-{key[1]:03d}", chunks)


def read_segments(segments: DataFrame, root: str) -> DataFrame:
    """ext_id, seg, cur, digest, otype, grains, cycle, payload, err of the records in ``segments`` (ext_id, seg, cur: where to begin, cycle).

    A record at a time is in memory.  Reading ends at the first unwritten place, damaged header or older cycle; a newer cycle than the
    segment's, or a header that names another extent, is a row with an error and ends it too.
    """
    schema = "ext_id long, seg long, cur long, digest long, otype int, grains long, cycle long, payload binary, err string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        kind = pa.schema([("ext_id", pa.int64()), ("seg", pa.int64()), ("cur", pa.int64()), ("digest", pa.int64()), ("otype", pa.int32()), ("grains", pa.int64()), ("cycle", pa.int64()), ("payload", pa.binary()), ("err", pa.string())])

        def records(ext_id, seg, cur, cycle):
            path = f"{base}/ext_{ext_id}/segment-{seg:03d}"
            if store.get_file_info(path).type == fs.FileType.NotFound:
                return
            with store.open_input_file(path) as f:
                size = f.size()
                while cur < size:
                    f.seek(cur)
                    try:
                        head = r.ObjectHeader.unpack(f.read(r.HEADER))
                    except r.BadRecord:
                        return
                    if head.cycle < cycle:
                        return
                    at = (ext_id, seg, cur)
                    if head.cycle > cycle or head.ext_id != ext_id or head.offset != cur:
                        yield (*at, None, None, None, head.cycle, None, "ExtentBroken")
                        return
                    oid = head.oid - OID_BASE
                    yield (*at, oid >> 2, oid & 3, head.grains, head.cycle, f.read(head.grains * r.GRAIN), None)
                    cur += -(-(r.HEADER + head.grains * r.GRAIN) // r.ALIGN) * r.ALIGN

        for batch in batches:
            for x in batch.to_pylist():
                rows, held = [], 0
                for row in records(x["ext_id"], x["seg"], x["cur"], x["cycle"]):
                    rows.append(row)
                    held += len(row[7] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    return segments.select("ext_id", "seg", "cur", "cycle").mapInArrow(run, schema)


def write_snapshots(index: DataFrame, states: DataFrame, root: str) -> DataFrame:
    """A binary snapshot of each extent in ``states`` (ext_id, snap_ts, history_idx, cur) from ``index``: header and blocks.

    Entries are streamed a block at a time, in order of their digests; the header needs their number, which is counted before.
    """
    counted = states.join(index.groupBy("ext_id").agg(F.count("*").alias("obj_cnt")), "ext_id", "left").fillna(0, ["obj_cnt"])
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("digest", "long"), ("otype", "int"), ("grains", "long"), ("addr", "long"))]
    heads = counted.select("ext_id", F.lit(-1).cast("long").alias("ord"), *nothing, F.struct("snap_ts", "history_idx", "cur", "obj_cnt").alias("head"))
    entries = index.join(states.select("ext_id"), "ext_id", "left_semi").select("ext_id", F.col("digest").alias("ord"), "digest", F.col("otype").cast("int").alias("otype"), "grains", "addr", F.lit(None).cast(heads.schema["head"].dataType).alias("head"))

    def chunks(key, rows):
        from itertools import islice

        h = next(rows)["head"]
        n, per = h["obj_cnt"], SNAP_ENTRIES_PER_BLOCK
        yield r.SnapshotHeader(n, -(-n // per), h["history_idx"], h["cur"], 0, 0, 0, 0, 0, h["snap_ts"], h["snap_ts"]).pack()
        while some := [(x["digest"], x["otype"], x["grains"], x["addr"]) for x in islice(rows, per)]:
            yield r.snapshot_block(n, some)

    return _written(heads.unionByName(entries), ("ext_id",), "ord", root, lambda key: "2.dmu_snap", chunks)


def write_deletes(log: DataFrame, root: str) -> DataFrame:
    """The delete log of each extent from ``log`` (ext_id, ts, kind, digests), in order of time."""

    def chunks(key, rows):
        for x in rows:
            yield r.delete_chunk(x["ts"], x["digests"], x["kind"] == "batch")
        yield bytes(4096)

    return _written(log.select("ext_id", "ts", "kind", "digests"), ("ext_id",), "ts", root, lambda key: DELETES, chunks)


def write_oid_lists(pieces: DataFrame, root: str) -> DataFrame:
    """The id lists of ``pieces`` (ext_id, piece, digests), as a clone's source publishes them: one file for each piece."""

    def chunks(key, rows):
        for x in rows:
            yield r.oid_list(x["digests"])

    return _written(pieces.select("ext_id", "piece", "digests", F.lit(0).alias("part")), ("ext_id", "piece"), "part", root, lambda key: f"oids-{key[1]:06d}", chunks)


def read_oid_lists(spark: SparkSession, roots: list[str]) -> DataFrame:
    """ext_id, piece, digests."""
    files = _files(spark, roots, "oids-*").withColumn("piece", F.regexp_extract("path", r"oids-([0-9]+)$", 1).cast("long"))
    return _decoded(files, "digests array<long>", lambda raw: [(r.read_oid_list(raw),)]).join(files.select("path", "piece"), "path").select("ext_id", "piece", "digests", "err")
