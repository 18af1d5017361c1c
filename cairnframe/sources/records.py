"""Binary records of an extent's files: little-endian, each with a CRC-32 of what it covers.

The byte ranges are those of the storage format, so that it is clear which field which checksum guards.  Files made here need not
be readable by other programs.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

from ..config import ALIGN, DELETE_LOG, GRAIN, HEADER, MAGIC_AT, SEGMENTS, SNAP_BLOCK

MAGIC = 0x6361_6972_6E66_7261
SINGLE, BATCH = 1, 2


class BadRecord(ValueError):
    pass


def _sealed(body: bytes, size: int) -> bytes:
    """``body`` padded to ``size`` with its checksum in the last four bytes."""
    if len(body) > size - 4:
        raise ValueError("the record is too long")
    body = body.ljust(size - 4, b"\0")
    return body + struct.pack("<I", zlib.crc32(body))


def _opened(raw: bytes, size: int, what: str) -> bytes:
    if len(raw) < size:
        raise BadRecord(f"{what} is cut off")
    if struct.unpack_from("<I", raw, size - 4)[0] != zlib.crc32(raw[: size - 4]):
        raise BadRecord(f"{what}: checksum")
    return raw[: size - 4]


@dataclass
class ObjectHeader:
    oid: int
    grains: int
    cycle: int
    ext_id: int
    offset: int

    def pack(self) -> bytes:
        head = struct.pack("<QIIIQ", self.oid, self.grains, self.cycle, self.ext_id, self.offset)
        return _sealed(head.ljust(MAGIC_AT, b"\0") + struct.pack("<Q", MAGIC), HEADER)

    @classmethod
    def unpack(cls, raw: bytes) -> ObjectHeader:
        """Checks in order: an id, the magic number, the checksum."""
        if len(raw) < HEADER:
            raise BadRecord("header is cut off")
        if not struct.unpack_from("<Q", raw)[0]:
            raise BadRecord("header: unwritten")
        if struct.unpack_from("<Q", raw, MAGIC_AT)[0] != MAGIC:
            raise BadRecord("header: magic")
        return cls(*struct.unpack_from("<QIIIQ", _opened(raw, HEADER, "header")))


def object_record(header: ObjectHeader, payload: bytes) -> bytes:
    """Header, whole grains of payload, padding up to the alignment."""
    body = header.pack() + payload.ljust(header.grains * GRAIN, b"\0")
    return body.ljust(-(-len(body) // ALIGN) * ALIGN, b"\0")


@dataclass
class ExtentHeader:
    state: int
    seg_size: int
    reserved: int
    states: list[int] = field(default_factory=lambda: [0] * SEGMENTS)
    sealed: list[int] = field(default_factory=lambda: [0] * SEGMENTS)
    history: list[int] = field(default_factory=lambda: [0] * SEGMENTS)
    next_idx: int = 1
    removed: list[int] = field(default_factory=lambda: [0] * SEGMENTS)
    cycles: list[int] = field(default_factory=lambda: [0] * SEGMENTS)
    clone_job: bytes = b""

    def pack(self) -> bytes:
        body = struct.pack("<IIB", self.state, self.seg_size, self.reserved) + bytes(self.states) + struct.pack(f"<{SEGMENTS}I", *self.sealed) + bytes(self.history) + struct.pack("<q", self.next_idx)
        body += struct.pack(f"<{SEGMENTS}I", *self.removed) + struct.pack(f"<{SEGMENTS}I", *self.cycles) + self.clone_job
        return _sealed(struct.pack("<I", len(body)) + body, HEADER)

    @classmethod
    def unpack(cls, raw: bytes) -> ExtentHeader:
        raw = _opened(raw, HEADER, "extent header")
        (n,) = struct.unpack_from("<I", raw)
        b, words = raw[4 : 4 + n], f"<{SEGMENTS}I"
        state, size, reserved = struct.unpack_from("<IIB", b)
        read = lambda at: list(struct.unpack_from(words, b, at))
        return cls(state, size, reserved, list(b[9:265]), read(265), list(b[1289:1545]), struct.unpack_from("<q", b, 1545)[0], read(1553), read(2577), b[3601:])


@dataclass
class SnapshotHeader:
    obj_cnt: int
    blocks: int
    history_idx: int
    cursor: int
    gc_src: int
    gc_dst: int
    gc_src_cur: int
    gc_dst_cur: int
    clone_done: int
    create_ts: int
    hlc_ts: int

    def pack(self) -> bytes:
        return _sealed(struct.pack("<IIqqqqqIIIqq", self.obj_cnt, self.blocks, self.history_idx, 0, self.cursor, self.gc_src, self.gc_dst, self.gc_src_cur, self.gc_dst_cur, self.clone_done, self.create_ts, self.hlc_ts), HEADER)

    @classmethod
    def unpack(cls, raw: bytes) -> SnapshotHeader:
        x = struct.unpack_from("<IIqqqqqIIIqq", _opened(raw, HEADER, "snapshot header"))
        return cls(*x[:3], *x[4:])


def pack_entry(digest: int, otype: int, grains: int, addr: int) -> bytes:
    return struct.pack("<QB", digest << 32 | otype << 30 | grains << 19 | addr >> 8, addr & 255)


def unpack_entry(raw: bytes) -> tuple[int, int, int, int]:
    e0, e1 = struct.unpack("<QB", raw)
    return e0 >> 32, e0 >> 30 & 3, e0 >> 19 & 2047, (e0 & 0xFFFF) << 8 | e1


def snapshot_block(slot_cnt: int, entries: list[tuple[int, int, int, int]]) -> bytes:
    return _sealed(struct.pack("<II", slot_cnt, len(entries)) + b"".join(pack_entry(*e) for e in entries), SNAP_BLOCK)


def read_snapshot_block(raw: bytes) -> tuple[int, list[tuple[int, int, int, int]]]:
    body = _opened(raw, SNAP_BLOCK, "snapshot block")
    slot_cnt, n = struct.unpack_from("<II", body)
    return slot_cnt, [unpack_entry(body[8 + 9 * i : 17 + 9 * i]) for i in range(n)]


def opened_block(raw: bytes) -> bytes:
    """The entries of a checked block, nine bytes each."""
    body = _opened(raw, SNAP_BLOCK, "snapshot block")
    return body[8 : 8 + 9 * struct.unpack_from("<I", body, 4)[0]]


def delete_chunk(ts: int, digests: list[int], batch: bool = False) -> bytes:
    """A single delete takes a block; a batch as many as its list needs."""
    if not batch and len(digests) != 1:
        raise ValueError("a single delete has one digest")
    body = struct.pack("<BIq", BATCH if batch else SINGLE, len(digests), ts) + struct.pack(f"<{len(digests)}I", *digests)
    return _sealed(body, -(-(len(body) + 4) // GRAIN) * GRAIN)


def read_delete_log(raw: bytes) -> list[tuple[int, str, list[int]]]:
    """(ts, kind, digests) of the chunks up to the first that is unwritten or damaged: what follows it never counted."""
    out, at = [], 0
    while at + GRAIN <= min(len(raw), DELETE_LOG):
        kind, n, ts = struct.unpack_from("<BIq", raw, at)
        size = -(-(13 + 4 * n + 4) // GRAIN) * GRAIN
        if kind not in (SINGLE, BATCH) or kind == SINGLE and n != 1:
            break
        try:
            body = _opened(raw[at : at + size], size, "delete chunk")
        except BadRecord:
            break
        out.append((ts, "single" if kind == SINGLE else "batch", list(struct.unpack_from(f"<{n}I", body, 13))))
        at += size
    return out


def boot_sector(version: int, salt: bytes = b"") -> bytes:
    return _sealed(struct.pack("<H", version) + salt, GRAIN)


def read_boot_sector(raw: bytes) -> int:
    return struct.unpack_from("<H", _opened(raw, GRAIN, "boot sector"))[0]


def oid_list(digests: list[int]) -> bytes:
    return struct.pack(f"<{len(digests)}Q", *digests)


def read_oid_list(raw: bytes) -> list[int]:
    """Ids of a packed batch request."""
    if len(raw) % 8:
        raise BadRecord("a list of ids has whole words")
    return list(struct.unpack(f"<{len(raw) // 8}Q", raw))
