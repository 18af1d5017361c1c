"""Scalar functions of the catalogue as Column expressions: all run inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALIGN, DELETE_LOG, GRAIN, HEADER, HOUR_NS, MAX_CAP, MIN_CAP, NEIGHBOUR, OIDS_PER_PIECE, SEALED_EPOCH_NS, SEGMENTS, SNAP_BLOCK, SNAP_ENTRIES_PER_BLOCK, SNAP_ENTRY, SNAP_HEADER


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def div(a, b) -> Column:
    """Quotient of two longs, truncated."""
    return F.call_function("div", col(a).cast("long"), col(b).cast("long"))


def ceil_div(a, b) -> Column:
    return div(col(a).cast("long") + col(b) - 1, b)


def align_size(n, to) -> Column:
    """The smallest multiple of ``to`` that holds n."""
    return ceil_div(n, to) * to


# sizes and places


def grains_of(n_bytes) -> Column:
    return F.greatest(F.lit(1).cast("long"), ceil_div(n_bytes, GRAIN))


def moved_bytes(grains) -> Column:
    """Bytes that an object takes up in a segment: header, grains, padding."""
    return align_size(HEADER + col(grains).cast("long") * GRAIN, ALIGN)


def moved_grains(grains) -> Column:
    return div(moved_bytes(grains), GRAIN)


def seg_cursor_to_offset(seg, cur, segment_size: int) -> Column:
    return col(seg).cast("long") * segment_size + col(cur)


def offset_to_addr(offset) -> Column:
    return div(offset, ALIGN)


def addr_of(seg, cur, segment_size: int) -> Column:
    return offset_to_addr(seg_cursor_to_offset(seg, cur, segment_size))


def addr_to_seg(addr, segment_size: int) -> Column:
    return div(col(addr).cast("long") * ALIGN, segment_size)


def offset_to_seg_cursor(offset, segment_size: int) -> Column:
    return F.struct(div(offset, segment_size).alias("seg"), F.pmod(col(offset).cast("long"), F.lit(segment_size)).alias("cur"))


# checksums and ids


def digest(payload) -> Column:
    """32-bit content key of a payload, as a long: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(col(payload).cast("binary")), 1, 8), 16, 10).cast("long")


def checksum(payload) -> Column:
    return F.crc32(col(payload).cast("binary"))


def make_oid(group, grains, dig, otype) -> Column:
    return F.struct(col(group).cast("int").alias("group_id"), col(grains).cast("int").alias("grains"), col(dig).cast("long").alias("digest"), col(otype).cast("smallint").alias("otype"))


# index entries: tag 16 | neighbour offset 6 | type 2 | grains 11 | padding 5 | address 24


def make_tag(dig) -> Column:
    d = col(dig).cast("long")
    return F.struct(F.shiftright(d, 16).bitwiseAND(F.lit(0xFFFF)).alias("tag"), d.bitwiseAND(F.lit(0xFFFF)).alias("low"))


def make_entry(dig, neigh_off, otype, grains, addr) -> Column:
    part = [(col(addr).cast("long").bitwiseAND(F.lit((1 << 24) - 1)), 0), (col(grains).cast("long"), 29), (col(otype).cast("long").bitwiseAND(F.lit(3)), 40), (col(neigh_off).cast("long"), 42), (make_tag(dig)["tag"], 48)]
    out = part[0][0]
    for value, at in part[1:]:
        out = out.bitwiseOR(F.shiftleft(value, at))
    return out


def _bits(entry: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(entry, at).bitwiseAND(F.lit((1 << width) - 1))


def parse_entry(entry) -> Column:
    e = col(entry).cast("long")
    fields = (("tag", 48, 16), ("neigh_off", 42, 6), ("otype", 40, 2), ("grains", 29, 11), ("addr", 0, 24))
    return F.struct(*[_bits(e, at, width).alias(n) for n, at, width in fields])


def calc_mask(slot_cnt) -> Column:
    c = col(slot_cnt).cast("long")
    return F.when(c <= NEIGHBOUR, c - 1).otherwise(c - NEIGHBOUR)


def calc_slot_cnt(cap) -> Column:
    c = col(cap).cast("long")
    return F.when(c <= NEIGHBOUR, c).otherwise(c + NEIGHBOUR - 1)


def origin_cap(slot_cnt) -> Column:
    c = col(slot_cnt).cast("long")
    return F.when(c <= NEIGHBOUR, c).otherwise(c + 1 - NEIGHBOUR)


def adjust_cap(wanted) -> Column:
    """Slots for a wanted capacity: the next power of two within limits, plus the overhang."""
    c = F.greatest(F.lit(MIN_CAP).cast("long"), F.least(F.lit(MAX_CAP).cast("long"), col(wanted).cast("long")))
    power = F.pow(F.lit(2.0), F.ceil(F.log2(c.cast("double")))).cast("long")
    return calc_slot_cnt(power)


def calc_slot(slot_cnt, dig) -> Column:
    return col(dig).cast("long").bitwiseAND(calc_mask(slot_cnt))


def back_to_digest(tag, slot_cnt, slot, neigh_off) -> Column:
    """A digest from what its entry and its slot still say."""
    mask = calc_mask(slot_cnt)
    high = F.lit(0xFFFFFFFF).cast("long").bitwiseXOR(mask)
    return F.shiftleft(col(tag).cast("long"), 16).bitwiseAND(high).bitwiseOR((col(slot).cast("long") - col(neigh_off)).bitwiseAND(mask))


def bit_one(p) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), col(p).cast("int"))


def set_bit(word, p) -> Column:
    return col(word).cast("long").bitwiseOR(bit_one(p))


def clear_bit(word, p) -> Column:
    return col(word).cast("long").bitwiseAND(F.bitwise_not(bit_one(p)))


# snapshots


def make_snap_entry(dig, otype, grains, addr) -> Column:
    a = col(addr).cast("long")
    e0 = F.shiftleft(col(dig).cast("long"), 32).bitwiseOR(F.shiftleft(col(otype).cast("long"), 30)).bitwiseOR(F.shiftleft(col(grains).cast("long"), 19)).bitwiseOR(F.shiftright(a, 8))
    return F.struct(e0.alias("e0"), a.bitwiseAND(F.lit(255)).alias("e1"))


def parse_snap_entry(e0, e1) -> Column:
    e = col(e0).cast("long")
    addr = F.shiftleft(_bits(e, 0, 16), 8).bitwiseOR(col(e1).cast("long"))
    return F.struct(_bits(e, 32, 32).alias("digest"), _bits(e, 30, 2).alias("otype"), _bits(e, 19, 11).alias("grains"), addr.alias("addr"))


def snap_blocks(n) -> Column:
    return ceil_div(n, SNAP_ENTRIES_PER_BLOCK)


def snap_bytes(n) -> Column:
    return SNAP_HEADER + snap_blocks(n) * SNAP_BLOCK


def snap_cost(n_bytes, age_ms) -> Column:
    """Cost of writing a snapshot now: it grows with the last one's size and falls as that ages; under 2 is acceptable."""
    return (2 + 0.25 * F.pow(col(n_bytes).cast("double"), F.lit(0.618))) * F.exp(F.lit(-0.000618) * col(age_ms).cast("double"))


def max_snapshot_bytes(segment_size: int, reserved: int = 1) -> int:
    """The space that is set aside for a snapshot: an entry for every aligned place that can be in use, one block to spare."""
    entries = SNAP_ENTRY * (segment_size * (SEGMENTS - reserved) // ALIGN)
    return SNAP_HEADER + (entries // SNAP_BLOCK + 1) * SNAP_BLOCK


def extent_bytes(segment_size: int, reserved: int = 1) -> int:
    """All space of an extent: segments, header, boot sector, two snapshots, delete log."""
    return SEGMENTS * segment_size + HEADER + GRAIN + 2 * max_snapshot_bytes(segment_size, reserved) + DELETE_LOG


def oid_pieces(n) -> Column:
    return ceil_div(col(n).cast("long"), OIDS_PER_PIECE)


# time


def sealed_hours(ns) -> Column:
    return div(col(ns).cast("long") - SEALED_EPOCH_NS, HOUR_NS)


def sealed_ns(hours) -> Column:
    return col(hours).cast("long") * HOUR_NS + SEALED_EPOCH_NS


# paths and rates


def ext_dir(root, ext_id) -> Column:
    return F.concat(col(root), F.lit("/ext_"), col(ext_id).cast("string"))


def ext_id_of(path) -> Column:
    """The id in the last part of a path, null if that is no extent's folder."""
    return F.nullif(F.regexp_extract(col(path), r"(?:^|/)ext_([0-9]+)/?$", 1), F.lit("")).cast("long")


def snapshot_path(ext_dir_, snap_ts) -> Column:
    return F.concat(col(ext_dir_), F.lit("/"), col(snap_ts).cast("string"), F.lit(".dmu_snap"))


def iops(n, cost_ns) -> Column:
    return F.when(col(cost_ns) > 0, col(n) / (col(cost_ns) / F.lit(1e9)))
