"""The engine end to end: what is put can be read, through deletes, collection, restart, cloning and reconciliation."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cairnframe.config import ExtentConfig
from cairnframe.engine import Engine
from cairnframe.functions import scalars as s
from cairnframe.sources import extents as files
from cairnframe.sources import records as r
from cairnframe.sources.versions import Conflict, Versions

CONFIG = ExtentConfig(segment_size=1 << 17)


def extents(spark, n):
    return spark.range(n).select(F.col("id").alias("ext_id"), F.lit(1).alias("version"), F.lit("d").alias("disk_id"))


def payloads(spark, n, n_extents, seed=1):
    rng = random.Random(seed)
    rows = [(i % n_extents, i, bytes([i % 256, i // 256, seed]) * rng.choice([1, 2000, 5000, 9000])) for i in range(n)]
    return spark.createDataFrame(rows, "ext_id long, seq long, payload binary")


def live(engine):
    """(ext_id, digest) -> payload as reads give it."""
    asked = engine.index.select("ext_id", "digest", F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("n"))
    got = engine.get(asked).collect()
    assert all(x.err is None for x in got)
    return {(x.ext_id, x.digest): bytes(x.piece) for x in got}


def no_overlap(engine):
    spans = sorted((x.ext_id, x.addr, x.addr + x.m) for x in engine.index.select("ext_id", "addr", (s.moved_bytes("grains") / 16384).cast("long").alias("m")).collect())
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_life_of_a_catalogue(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/a", CONFIG)
    engine.create_extents(extents(spark, 2))
    first = payloads(spark, 120, 2)
    assert engine.put(first).where("err IS NOT NULL").count() == 0
    assert {x.err for x in engine.put(first).collect()} == {"ObjDigestExisted"}
    want = {(x.ext_id, x.digest): bytes(x.payload) for x in first.withColumn("digest", s.digest("payload")).collect()}
    assert live(engine) == want
    no_overlap(engine)

    keys = sorted(want)[::2]
    gone = engine.delete(spark.createDataFrame(keys, "ext_id long, digest long"), batch=True)
    assert gone.where("addr IS NOT NULL").count() == len(keys)
    left = {k: v for k, v in want.items() if k not in set(keys)}
    assert live(engine) == left
    assert [x.err for x in engine.delete(spark.createDataFrame(keys[:1], "ext_id long, digest long")).collect()] == ["NotFound"]
    assert "ObjectDirtyDeleted" in {x.err for x in engine.put(first).collect()}
    sealed = engine.segments().where("state = 'Sealed'").collect()
    assert sealed and all(x.sealed_hours > 0 for x in sealed)

    assert {x.addr // 8 for x in engine.gc(0.01).collect()} <= {0}  # no snapshot covers what was opened since
    engine.snapshot()
    for turn in range(2):  # collection keeps the live set and frees space, again and again
        before = engine.segments().where("state = 'Ready'").count()
        moves = engine.gc(0.01)
        assert moves.count() > 0 or turn == 1
        assert live(engine) == left
        no_overlap(engine)
        assert engine.segments().where("state = 'Ready'").count() >= before
        reserved = engine.segments().where("state = 'Reserved'").groupBy("ext_id").count().collect()
        assert [x["count"] for x in reserved] == [1, 1]

    engine.snapshot()
    assert engine.put(first).where("err IS NULL").count() == len(keys)
    again = Engine(spark, f"file://{tmp_path}/a", CONFIG)  # a restart reads the manifest and nothing else
    assert live(again) == want
    no_overlap(again)
    assert again.store.vacuum() > 0
    assert live(again) == want


def test_delete_cap(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/a", ExtentConfig(segment_size=1 << 17, single_delete_cap=3))
    engine.create_extents(extents(spark, 1))
    engine.put(payloads(spark, 6, 1))
    keys = engine.index.select("ext_id", "digest")
    errs = [x.err for x in engine.delete(keys).collect()]
    assert sorted(e or "" for e in errs) == ["", "", "", "TooManyRequests", "TooManyRequests", "TooManyRequests"]
    engine.snapshot()
    assert engine.delete(engine.index.select("ext_id", "digest")).where("err IS NULL").count() == 3


def test_full_and_unknown_extents(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/a", ExtentConfig(segment_size=16384))
    engine.create_extents(extents(spark, 1))
    rows = spark.range(257).select((F.col("id") == 256).cast("long").alias("ext_id"), F.col("id").alias("seq"), F.col("id").cast("string").cast("binary").alias("payload"))
    got = {x.seq: x.err for x in engine.put(rows).collect()}
    assert got[255] == "ExtentFull" and got[256] == "NotFound" and sum(v is None for v in got.values()) == 255
    assert engine.extents.first().state == "Full"
    assert {x.err for x in engine.put(rows.where("seq = 255")).collect()} == {"ExtentFull"}


def test_clone_copies_the_key_set(spark, tmp_path):
    a, b = (Engine(spark, f"file://{tmp_path}/{x}", CONFIG) for x in "ab")
    for e in (a, b):
        e.create_extents(extents(spark, 2))
    a.put(payloads(spark, 60, 2))
    b.put(payloads(spark, 60, 2).where("seq % 3 = 0"))
    report = b.clone(a).collect()
    assert live(b) == live(a)
    assert {(x.total, x.done, x.missing, x.state) for x in report} == {(30, 30, 0, "Done")}


def test_reconcile_applies(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/a", CONFIG)
    engine.create_extents(extents(spark, 3))
    engine.put(payloads(spark, 30, 3))
    rows = [(0, "ReadWrite", 1, 0, 1, False), (1, "Broken", 1, 0, 1, False), (9, "ReadWrite", 0, 0, 1, False)]
    engine.reconcile(spark.createDataFrame(rows, "ext_id long, state string, created int, group_id int, version int, new_source boolean"))
    assert {(x.ext_id, x.state) for x in engine.extents.collect()} == {(0, "ReadWrite"), (1, "Broken"), (9, "ReadWrite")}
    assert {k[0] for k in live(engine)} == {0}
    assert {x.err for x in engine.put(payloads(spark, 30, 3, 2).where("ext_id = 1")).collect()} == {"ExtentBroken"}


def test_versions_refuse_a_second_writer(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}")
    now = store.current()
    store.commit(now)
    with pytest.raises(Conflict):
        store.commit(now)


def test_files_of_extents(spark, tmp_path):
    root = f"file://{tmp_path}"
    files.write_extents(spark.range(5).selectExpr("id AS ext_id", "1 AS version"), root, 1 << 20).count()
    os.makedirs(tmp_path / "other")
    (tmp_path / "other" / "boot-sector").write_bytes(b"")
    (tmp_path / "ext_3" / "boot-sector").write_bytes(b"x" * 4096)
    (tmp_path / "ext_1" / "dirty-delete-wal").write_bytes(r.delete_chunk(5, [7]) + r.delete_chunk(6, list(range(9000)), True) + bytes(4096))
    block = r.snapshot_block(65599, [(1, 1, 2, 3), (9, 1, 2, 8)])
    (tmp_path / "ext_2" / "50.dmu_snap").write_bytes(r.SnapshotHeader(2, 1, 0, 0, 0, 0, 0, 0, 0, 50, 50).pack() + block)
    got = {x.ext_id: (x.version, x.err) for x in files.list_extents(spark, [root]).collect()}
    assert set(got) == set(range(5)) and got[0] == (1, None) and got[3] == (None, "boot sector: checksum")
    segments = files.segments_of(files.read_headers(spark, [root])).where("ext_id = 0")
    assert segments.count() == 256 and segments.where("seg = 0").first().state == 2 and segments.where("seg = 255").first().state == 1
    log = files.read_deletes(spark, [root]).where("err IS NULL").collect()
    assert [(x.ts, x.kind, len(x.digests)) for x in sorted(log, key=lambda x: x.ts)] == [(5, "single", 1), (6, "batch", 9000)]
    assert sorted((x.digest, x.addr) for x in files.read_snapshots(spark, [root]).where("digest IS NOT NULL").collect()) == [(1, 3), (9, 8)]
