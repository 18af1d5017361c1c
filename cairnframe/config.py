"""Sizes, limits and options of the object catalogue."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

# fixed values of the storage format
GRAIN = 4096
HEADER = 4096
ALIGN = 16384
MAX_OBJECT = 4 << 20
SEGMENTS = 256
SNAP_BLOCK, SNAP_HEADER, SNAP_ENTRY, SNAP_ENTRIES_PER_BLOCK = 32768, 4096, 9, 3639
DELETE_LOG = 4 << 20
OIDS_PER_PIECE = (4 << 20) // 8
MIN_CAP, MAX_CAP, NEIGHBOUR = 1 << 16, 1 << 25, 64
SEALED_EPOCH_NS = 1616988479613927876
HOUR_NS = 3_600_000_000_000
MAGIC_AT = 1234

# segment states
READY, RESERVED, WRITABLE, SEALED = "Ready", "Reserved", "Writable", "Sealed"
# extent states
READ_WRITE, FULL, EXT_SEALED, CLONE, BROKEN = "ReadWrite", "Full", "Sealed", "Clone", "Broken"


@dataclass(frozen=True)
class ExtentConfig:
    segment_size: int = 1 << 30
    reserved_seg: int = 1
    put_pending: int = 512
    size_per_read: int = 4 << 20
    max_dirty_count: int = 0
    development: bool = False
    update_or_insert: bool = False
    single_delete_cap: int = 512
    batch_delete_cap: int = 8192
    disable_gc: bool = False
    gc_ratio: float = 0.55
    gc_interval_s: int = 24 * 3600
    gc_scan_interval_s: int = 3600
    deep_gc_interval_s: int = 30 * 24 * 3600

    def adjusted(self) -> ExtentConfig:
        """With defaults filled in: upserts need development mode; a user's ``max_dirty_count`` wins over the derived one."""
        dirty = self.max_dirty_count or max(1, self.segment_size // (4 << 20) // 2)
        return replace(self, max_dirty_count=dirty, update_or_insert=self.update_or_insert and self.development)

    @property
    def usable_segments(self) -> int:
        return SEGMENTS - self.reserved_seg


@dataclass(frozen=True)
class ServerConfig:
    data_root: str = "/zai"
    object_address: str = "0.0.0.0:8881"
    operator_address: str = "0.0.0.0:8882"
    group_id: int = 1
    heartbeat_s: float = 10.0
    snapshot_s: float = 10.0


@dataclass(frozen=True)
class PerfConfig:
    """Options of a performance run: sizes in the units their names say."""

    extents_per_disk: int = 1
    block_size_kb: int = 12
    job_type: str = "rw"
    job_time_s: float = 30.0
    skip_time_s: float = 1.0
    mb_per_put_thread: int = 1024
    mb_per_get_thread: int = 1024
    put_threads: int = 16
    get_threads: int = 16

    def per_thread(self, mb: int) -> int:
        return mb * 1024 // self.block_size_kb


#: version -> configuration: the extension point for other extent kinds
EXTENT_VERSIONS: dict[int, ExtentConfig] = {v: ExtentConfig() for v in (1, 2, 3, 4, 5)}


def register_version(version: int, config: ExtentConfig) -> None:
    EXTENT_VERSIONS[version] = config


def advertised_versions() -> list[int]:
    return sorted(EXTENT_VERSIONS)


def _section(kind: type, given: dict, name: str):
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"[{name}] has no option {', '.join(sorted(unknown))}")
    return kind(**given)


def load(path: str | Path) -> tuple[ServerConfig, ExtentConfig, PerfConfig]:
    """The sections ``server``, ``extent`` and ``perf`` of a TOML file; what it leaves out has its default, what it misspells is refused."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    unknown = set(found) - {"server", "extent", "perf"}
    if unknown:
        raise ValueError(f"no section {', '.join(sorted(unknown))}")
    server, extent, perf = (_section(k, found.get(n, {}), n) for k, n in ((ServerConfig, "server"), (ExtentConfig, "extent"), (PerfConfig, "perf")))
    return server, extent.adjusted(), perf
