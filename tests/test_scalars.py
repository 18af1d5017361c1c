"""Codecs and scalar functions: exact values and round trips."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnframe import config
from cairnframe.functions import scalars as s
from cairnframe.operators.snapshot import worth_writing
from cairnframe.sources import records as r

U32 = st.integers(0, 2**32 - 1)


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_entry_round_trip(spark):
    rows = [(0, 0, 1, 1, 0), (2**32 - 1, 63, 3, 2047, 2**24 - 1), (0xDEADBEEF, 17, 2, 1024, 99999), (1 << 31, 1, 0, 1, 1)]
    df = spark.createDataFrame(rows, "d long, n long, o long, g long, a long")
    got = df.select("*", s.parse_entry(s.make_entry("d", "n", "o", "g", "a")).alias("x"), s.parse_snap_entry(s.make_snap_entry("d", "o", "g", "a")["e0"], s.make_snap_entry("d", "o", "g", "a")["e1"]).alias("y")).collect()
    for x in got:
        assert tuple(x.x) == (x.d >> 16, x.n, x.o, x.g, x.a)
        assert tuple(x.y) == (x.d, x.o, x.g, x.a)


def test_places_and_sizes(spark):
    size = 1 << 20
    assert one(spark, s.moved_bytes(F.lit(1)), s.moved_bytes(F.lit(3)), s.moved_bytes(F.lit(4)), s.grains_of(F.lit(0)), s.grains_of(F.lit(4097))) == (16384, 16384, 32768, 1, 2)
    assert one(spark, s.addr_of(F.lit(3), F.lit(32768), size), s.addr_to_seg(F.lit(194), size), s.offset_to_seg_cursor(F.lit(3 * size + 7), size)) == (194, 3, (3, 7))


def test_capacities(spark):
    assert one(spark, *[s.adjust_cap(F.lit(x)) for x in (1, 65536, 65537, 1 << 30)]) == (65599, 65599, 131135, (1 << 25) + 63)
    assert one(spark, s.origin_cap(F.lit(65599)), s.calc_mask(F.lit(65599)), s.calc_mask(F.lit(64)), s.calc_slot_cnt(F.lit(64))) == (65536, 65535, 63, 64)


def test_bits_paths_pieces(spark):
    assert one(spark, s.set_bit(F.lit(0), F.lit(5)), s.clear_bit(F.lit(63), F.lit(5))) == (32, 31)
    assert one(spark, s.ext_id_of(F.lit("file:/x/ext_12/")), s.ext_id_of(F.lit("/x/old_12")), s.ext_dir(F.lit("/x"), F.lit(7))) == (12, None, "/x/ext_7")
    m = config.OIDS_PER_PIECE
    assert one(spark, *[s.oid_pieces(F.lit(n)) for n in (0, 1, m, m + 1, 2 * m, 2 * m + 1)]) == (0, 1, 1, 2, 2, 3)


def test_snapshot_cost_gate(spark):
    a, b = one(spark, s.snap_cost(F.lit(1 << 19), F.lit(10_000)), s.snap_cost(F.lit(256 << 20), F.lit(16_000)))
    assert (round(a, 2), round(b, 2)) == (1.78, 2.05)
    assert one(spark, worth_writing(F.lit(1 << 19), F.lit(10_000)), worth_writing(F.lit(256 << 20), F.lit(16_000)), worth_writing(F.lit(256 << 20), F.lit(0), F.lit(False))) == (True, False, True)
    assert round(s.max_snapshot_bytes(1 << 30) / 2**20, 2) == 143.47


def test_sealed_hours_round_trip(spark):
    rows = spark.range(1024).select("id", s.sealed_hours(s.sealed_ns("id")).alias("h")).collect()
    assert all(x.id == x.h for x in rows)


def test_config():
    c = config.ExtentConfig(update_or_insert=True, max_dirty_count=9).adjusted()
    assert not c.update_or_insert and c.max_dirty_count == 9
    assert config.ExtentConfig().adjusted().max_dirty_count == 128
    assert config.ExtentConfig(update_or_insert=True, development=True).adjusted().update_or_insert
    assert config.PerfConfig().per_thread(12) == 1024
    assert config.advertised_versions() == [1, 2, 3, 4, 5]


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 2**64 - 1), st.integers(1, 1024), U32, U32, st.integers(0, 2**62))
def test_object_header(oid, grains, cycle, ext, offset):
    raw = r.ObjectHeader(oid, grains, cycle, ext, offset).pack()
    assert len(raw) == 4096 and r.ObjectHeader.unpack(raw) == r.ObjectHeader(oid, grains, cycle, ext, offset)
    for at in (0, 20, 1234, 4095):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(r.BadRecord):
            r.ObjectHeader.unpack(bytes(bad))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(U32, st.integers(0, 3), st.integers(0, 2047), st.integers(0, 2**24 - 1)), max_size=50), st.lists(st.tuples(st.integers(0, 2**62), st.lists(U32, min_size=1, max_size=2000)), max_size=4))
def test_blocks_and_delete_log(entries, chunks):
    assert r.read_snapshot_block(r.snapshot_block(65599, entries)) == (65599, entries)
    raw = b"".join(r.delete_chunk(ts, d, True) for ts, d in chunks)
    want = [(ts, "batch", d) for ts, d in chunks]
    assert r.read_delete_log(raw + bytes(4096)) == want
    if chunks:  # a damaged chunk ends the log
        bad = bytearray(raw)
        bad[-1] ^= 1
        assert r.read_delete_log(bytes(bad)) == want[:-1]


def test_headers_round_trip():
    h = r.ExtentHeader(1, 1 << 30, 1, next_idx=5, clone_job=b"job")
    h.removed[7], h.states[3] = 99, 2
    assert r.ExtentHeader.unpack(h.pack()) == h
    x = r.SnapshotHeader(1, 1, 3, 4, 5, 6, 7, 8, 100, 9, 10)
    assert r.SnapshotHeader.unpack(x.pack()) == x
    assert r.read_boot_sector(r.boot_sector(2, b"salt")) == 2
    assert r.read_oid_list(r.oid_list([1, 2**63])) == [1, 2**63]
    record = r.object_record(r.ObjectHeader(1, 2, 0, 3, 0), b"abc")
    assert len(record) == 16384 and record[4096:4099] == b"abc"
    assert zlib.crc32(b"abc") == 0x352441C2
