"""The periodic work of a server: heartbeats, snapshots, collection, clone polling, and their end.

A :class:`Service` holds loops, each due when its interval has passed or when it was forced.  ``tick`` runs what is due, one after
the other, on the caller's thread; ``run`` ticks until it is told to stop.  Nothing here keeps data: each action is a job or a commit.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ServerConfig
from ..engine import Engine
from ..operators import clone, metrics, reconcile

RUNNING, CLOSED = "Running", "Closed"


@dataclass
class Loop:
    name: str
    every_s: float
    action: Callable[[], object]
    last: float | None = None
    forced: bool = False
    failures: int = 0

    def due(self, now: float) -> bool:
        return self.forced or self.last is None or now - self.last >= self.every_s


@dataclass
class Service:
    """An engine and its loops.  ``ask`` gives a heartbeat's answer to what the server reports (None: no keeper)."""

    engine: Engine
    server: ServerConfig = field(default_factory=ServerConfig)
    disks: DataFrame | None = None
    ask: Callable[[DataFrame], DataFrame | None] | None = None
    clone_source: Callable[[], Engine | None] | None = None
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self) -> None:
        c = self.engine.config
        self.state, self._stop = RUNNING, threading.Event()
        self.loops = {x.name: x for x in (Loop("heartbeat", self.server.heartbeat_s, self.heartbeat), Loop("snapshot", self.server.snapshot_s, self.engine.maybe_snapshot), Loop("clone", 15.0, self.poll_clone))}
        if not c.disable_gc:
            self.loops |= {x.name: x for x in (Loop("gc", c.gc_interval_s, self.engine.gc), Loop("deep_gc", c.deep_gc_interval_s, lambda: self.engine.gc(deep=True)))}
            for name in ("gc", "deep_gc"):  # not at once
                self.loops[name].last = self.clock()

    def heartbeat(self) -> DataFrame | None:
        """Report, and apply what the answer asks for; returns the actions."""
        if self.ask is None:
            return None
        size = self.engine.config.segment_size
        mine = self.engine.extents.withColumn("avail", F.size("ready") * F.lit(size).cast("long"))
        disks = self.disks if self.disks is not None else mine.select("disk_id").distinct().select("disk_id", F.lit("ReadWrite").alias("state"), *[F.lit(None).cast("long").alias(c) for c in ("size", "used")])
        answer = self.ask(reconcile.heartbeat(disks, mine))
        return None if answer is None else self.engine.reconcile(answer)

    def poll_clone(self) -> DataFrame | None:
        """Copy from the source once it is there; its keys that are here already are not copied again."""
        source = self.clone_source() if self.clone_source else None
        if source is None or clone.missing(source.index, self.engine.index).isEmpty():
            return None
        return self.engine.clone(source)

    def force(self, name: str) -> None:
        """Have a loop run at the next tick whatever its interval."""
        self.loops[name].forced = True

    def tick(self) -> list[str]:
        """Run what is due; returns the names.  A failing action is counted and does not end the others."""
        if self.state == CLOSED:
            raise RuntimeError("the service is closed")
        done, now = [], self.clock()
        for loop in self.loops.values():
            if loop.due(now):
                loop.last, loop.forced = now, False
                try:
                    loop.action()
                    done.append(loop.name)
                except Exception:
                    loop.failures += 1
        return done

    def run(self, pause_s: float = 1.0) -> None:
        while not self._stop.wait(pause_s):
            self.tick()
        self.close()

    def stop(self) -> None:
        self._stop.set()

    def close(self) -> None:
        """No more loops; the last state is a snapshot, so that a restart reads no log."""
        if self.state != CLOSED:
            self.state = CLOSED
            self.engine.maybe_snapshot(force=True)

    def scrape(self) -> str:
        """The server's metrics as text."""
        segments = self.engine.segments().groupBy("ext_id", "state").agg(F.count("*").alias("n"))
        keys = self.engine.index.groupBy("ext_id").agg(F.count("*").alias("n"))
        loops = self.engine.spark.createDataFrame([(x.name, x.failures) for x in self.loops.values()], "loop string, n long")
        return metrics.exposition(segments, "segments", ["ext_id", "state"], "n") + metrics.exposition(keys, "objects", ["ext_id"], "n") + metrics.exposition(loops, "loop_failures", ["loop"], "n", "counter")
