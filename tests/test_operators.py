"""Operators against small models in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cairnframe.config import ExtentConfig
from cairnframe.operators import catalog, clone, gc, guards, metrics, reconcile, recovery, snapshot
from cairnframe.operators.placement import place
from cairnframe.streaming import index_state

PUTS = "ext_id long, seq long, digest long, grains long, otype smallint"


def moved(grains):
    return -(-(4096 + 4096 * grains) // 16384) * 16384


def model(rows, size, usable):
    """Next-fit by the rules, one extent."""
    seg = cur = 0
    full, out = False, {}
    for seq, grains in sorted(rows):
        if moved(grains) > size:
            out[seq] = "ObjectTooLarge"
        elif full:
            out[seq] = "ExtentFull"
        else:
            if cur + moved(grains) > size:
                if seg + 1 >= usable:
                    full, out[seq] = True, "ExtentFull"
                    continue
                seg, cur = seg + 1, 0
            out[seq] = (seg, cur)
            cur += moved(grains)
    return out


@pytest.mark.parametrize("size", [1 << 16, 1 << 18])
def test_placement_is_next_fit(spark, size):
    rng = random.Random(size)
    rows = [(e, i, i, rng.choice([1, 3, 4, 7, 11, 15, 16, 80]), 1) for e in range(5) for i in range(rng.choice([0, 1, 300, 1500]))]
    got = place(spark.createDataFrame(rows, PUTS), ExtentConfig(segment_size=size)).collect()
    assert len(got) == len(rows)
    for e in range(5):
        want = model([(x[1], x[3]) for x in rows if x[0] == e], size, 255)
        assert {x.seq: x.err or (x.seg, x.cur) for x in got if x.ext_id == e} == want
        assert all(x.addr == (x.seg * size + x.cur) // 16384 for x in got if x.ext_id == e and not x.err)


def test_255_single_grain_objects_fill_an_extent(spark):
    rows = [(0, i, i, 1, 1) for i in range(256)]
    got = place(spark.createDataFrame(rows, PUTS), ExtentConfig(segment_size=16384)).collect()
    assert sorted(x.seg for x in got if not x.err) == list(range(255))
    assert [x.seq for x in got if x.err == "ExtentFull"] == [255]


def test_history_that_no_snapshot_covers_is_not_overwritten(spark):
    state = spark.createDataFrame([(0, 3, 16384, 260, 4, [9])], "ext_id long, seg long, cur long, history_next long, snap_idx long, ready array<int>")
    got = place(spark.createDataFrame([(0, 1, 1, 1, 1)], PUTS), ExtentConfig(segment_size=16384), state).collect()
    assert got[0].err == "ExtentBroken"
    got = place(spark.createDataFrame([(0, 1, 1, 1, 1)], PUTS), ExtentConfig(segment_size=16384), state.withColumn("snap_idx", F.lit(5).cast("long"))).collect()
    assert (got[0].seg, got[0].cur, got[0].history_idx) == (9, 0, 260)


def test_put_order_of_errors(spark):
    rows = [(0, 0, 10, 1, 1), (0, 1, 10, 2, 1), (0, 2, 11, 1, 1), (0, 3, 12, 1, 1), (0, 4, 13, 900, 1), (1, 5, 11, 1, 1), (0, 6, 13, 1, 1)]
    index = spark.createDataFrame([(0, 11)], "ext_id long, digest long")
    dirty = spark.createDataFrame([(0, 12), (0, 11)], "ext_id long, digest long")
    config = ExtentConfig(segment_size=1 << 18)
    got = {x.seq: x.err for x in catalog.put(spark.createDataFrame(rows, PUTS), config, index, dirty).collect()}
    assert got == {0: None, 1: "ObjDigestExisted", 2: "ObjectDirtyDeleted", 3: "ObjectDirtyDeleted", 4: "ObjectTooLarge", 5: None, 6: None}
    upsert = ExtentConfig(segment_size=1 << 18, update_or_insert=True, development=True)
    got = {x.seq: x.err for x in catalog.put(spark.createDataFrame(rows[2:3], PUTS), upsert, index).collect()}
    assert got == {2: None}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], PUTS)
    assert catalog.put(empty, ExtentConfig()).count() == 0
    index = catalog.put(empty, ExtentConfig())
    assert gc.segment_table(index, ExtentConfig()).count() == 0
    assert clone.export_chunks(index).count() == 0


def test_get_range(spark):
    objects = spark.createDataFrame([(0, 900150983 + 0, b"abc")], "ext_id long, digest long, payload binary")
    from cairnframe.functions import scalars as s

    objects = objects.withColumn("digest", s.digest("payload"))
    d = objects.first().digest
    asked = [(0, d, 0, 0), (0, d, 1, 2), (0, d, 2, 2), (0, d + 1, 0, 0), (0, d, 0, 3)]
    got = catalog.get_range(spark.createDataFrame(asked, "ext_id long, digest long, offset long, n long"), objects).collect()
    by = {(x.digest, x.offset, x.n): (bytes(x.piece) if x.piece is not None else None, x.err, x.is_full) for x in got}
    assert by == {(d, 0, 0): (b"abc", None, True), (d, 1, 2): (b"bc", None, False), (d, 2, 2): (None, "OutOfRange", False), (d + 1, 0, 0): (None, "NotFound", True), (d, 0, 3): (b"abc", None, True)}


def test_gc_ranking_and_unfinished_source(spark):
    rows = [(0, i, "Sealed", removed, hours) for i, (removed, hours) in enumerate([(5, 9), (9, 3), (9, 2), (9, 2), (1, 1)])] + [(0, 7, "Writable", 60, 0)]
    segments = spark.createDataFrame(rows, "ext_id long, seg long, state string, removed long, sealed_hours long")
    got = [x.seg for x in gc.candidates(segments, 5 / 64, 1 << 18).orderBy("rank").collect()]
    assert got == [2, 3, 1, 0]
    first = spark.createDataFrame([(0, 4)], "ext_id long, seg long")
    behind = spark.createDataFrame([(0, 3)], "ext_id long, seg long")
    got = [x.seg for x in gc.candidates(segments, 5 / 64, 1 << 18, behind, first).orderBy("rank").collect()]
    assert got == [4, 2, 1, 0]


def test_lost_writes(spark):
    size = 1 << 18
    rows = [(0, 0, 0, 200000, 16384), (0, 1, 1, size - 16384, 49152), (0, 2, 2, 16384, 16384), (0, 3, 3, 5, 5)]
    ends = spark.createDataFrame(rows, "ext_id long, seg long, history_idx long, end long, first_bytes long")
    got = {x.seg: x.err for x in recovery.lost_writes(ends, size, 140000).collect()}
    assert got == {0: "ExtentBroken", 1: "ExtentBroken", 2: "LostWrite"}


def test_reconcile_truth_table(spark):
    rows = [(1, "ReadWrite", 0, 0, 1, False), (2, "ReadWrite", 0, 9, 1, False), (3, "ReadWrite", 5, 0, 1, False), (4, "Broken", 5, 0, 1, False), (5, "ReadWrite", 5, 0, 1, False), (6, "Sealed", 5, 0, 1, True), (8, "ReadWrite", 0, 0, 9, False)]
    response = spark.createDataFrame(rows, "ext_id long, state string, created int, group_id int, version int, new_source boolean")
    local = spark.createDataFrame([(4,), (5,), (6,), (7,)], "ext_id long")
    groups = spark.createDataFrame([(0,)], "group_id int")
    got = {x.ext_id: x.action for x in reconcile.actions(response, local, groups, [1]).collect()}
    assert got == {1: "create", 2: "skip", 3: "broken", 4: "replace", 5: "update", 6: "clone_source", 7: "delete", 8: "skip"}


def test_guard_of_a_closed_or_retired_server(spark):
    asked = spark.createDataFrame([(1, 1)], "ext_id long, group_id int")
    extents = spark.createDataFrame([(1, "ReadWrite", "d")], "ext_id long, state string, disk_id string")
    disks = spark.createDataFrame([("d", "ReadWrite")], "disk_id string, state string")
    assert [guards.request_guard(asked, extents, disks, state, 1, closed).first().err for state, closed in (("Up", False), ("Tombstone", False), ("Tombstone", True))] == [None, "ServerTombstone", "ServiceClosed"]


def test_snapshot_helpers(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "ext_id long, snap_ts long, x string")
    assert {(x.ext_id, x.snap_ts, x.x) for x in snapshot.latest(rows).collect()} == {(1, 7, "b"), (2, 1, "c")}
    assert [(x.ext_id, x.snap_ts) for x in snapshot.superseded(rows).collect()] == [(1, 5)]
    entries = spark.createDataFrame([(1, 9, 100, 1), (1, 9, 50, 0)], "ext_id long, digest long, addr long, table int")
    assert [x.addr for x in snapshot.deduplicated(entries).collect()] == [50]


def test_clone_predicates(spark):
    job = "struct<id:long,parent_id:long,is_source:boolean,state:string,total:long,done:long,oids_oid:decimal(20,0)>"
    rows = [("Sealed", (1, 2, True, "Init", 0, 0, None)), ("Sealed", None), ("ReadWrite", (1, 2, True, "Init", 0, 0, None)), ("Clone", (1, 2, False, "Doing", 5, 0, None))]
    df = spark.createDataFrame(rows, f"state string, job {job}")
    got = df.select(clone.source_ready(F.col("state"), F.col("job")).alias("s"), clone.destination_ready(F.col("state"), F.col("job")).alias("d")).collect()
    assert [bool(x.s) for x in got] == [True, False, False, False] and [bool(x.d) for x in got] == [False, False, False, True]


def test_approximate_quantiles_follow_the_exact_ones(spark):
    rows = spark.range(2000).select(F.lit("put").alias("op"), F.lit(10).cast("long").alias("t_ns"), (F.col("id") * 7919 % 2003).alias("latency_ns"))
    exact, near = ({x.pct: x.value for x in metrics.quantiles(rows, 0, e).collect()} for e in (True, False))
    assert len(exact) == 17 and all(abs(exact[p] - near[p]) <= 4 for p in exact)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k % 2, i, rng.choice(["put", "delete", "readdress", "get"]), k, i) for i in range(400) for k in [rng.choice([1, 1, 1, 2, 3, 4])]]
    schema = index_state.OP_LOG
    for n, part in enumerate((rows[:150], rows[150:151], rows[151:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ops = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        index_state.start(ops, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    want = index_state.batch_state(spark.createDataFrame(rows, schema))
    got = index_state.newest(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
