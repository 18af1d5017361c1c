"""The catalogue as an object: state in versioned tables, every method one commit.

``Engine(spark, root)`` keeps five tables: ``log`` (records with payload, append only until collected), ``index``, ``deletes`` (since the
last snapshot), ``extents``, ``history`` (which segments were opened, and when); a snapshot is a commit that remembers the position in
the log and clears the deletes.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import READ_WRITE, ExtentConfig
from .functions import scalars as s
from .operators import catalog, clone, gc, reconcile, snapshot
from .operators.guards import first_error, modify_guard, read_guard, write_guard
from .operators.joins import join_dimension
from .sources.versions import Versions

KEY = ["ext_id", "digest"]
LOG = "ext_id long, digest long, grains long, otype smallint, addr long, cycle long, payload binary"
INDEX = "ext_id long, digest long, grains long, otype smallint, addr long, seg long, history_idx long, seq long"
DELETES = "ext_id long, digest long, ts long"
HISTORY = "ext_id long, seg long, history_idx long, opened_ns long"
EXTENTS = "ext_id long, version smallint, state string, disk_id string, seg long, cur long, history_next long, snap_idx long, ready array<int>"


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: ExtentConfig | None = None):
        self.spark, self.config = spark, (config or ExtentConfig()).adjusted()
        self.store = Versions(spark, root)

    def _table(self, name: str, now: dict | None = None) -> DataFrame:
        return self.store.read(name, {"log": LOG, "index": INDEX, "deletes": DELETES, "extents": EXTENTS, "history": HISTORY}[name], now)

    @property
    def index(self) -> DataFrame:
        return self._table("index")

    @property
    def extents(self) -> DataFrame:
        return self._table("extents")

    def create_extents(self, extents: DataFrame) -> None:
        """Add extents (ext_id, version, disk_id) that are not there; each starts with segment 0 writable."""
        now = self.store.current()
        old = self._table("extents", now)
        ready = F.array(*[F.lit(i) for i in range(1, self.config.usable_segments)])
        zero = F.lit(0).cast("long")
        new = extents.join(old, "ext_id", "left_anti").select("ext_id", F.col("version").cast("smallint").alias("version"), F.lit(READ_WRITE).alias("state"), "disk_id", zero.alias("seg"), zero.alias("cur"), F.lit(1).cast("long").alias("history_next"), zero.alias("snap_idx"), ready.alias("ready"))
        opened = new.select("ext_id", zero.alias("seg"), zero.alias("history_idx"), F.lit(time.time_ns()).cast("long").alias("opened_ns"))
        self.store.commit(now, append={"extents": self.store.write("extents", new), "history": self.store.write("history", opened)})

    def put(self, objects: DataFrame) -> DataFrame:
        """Put ``objects`` (ext_id, seq, payload, and otype if there are types); returns seq, digest, addr and err of each, as committed."""
        now = self.store.current()
        extents, index, deletes = (self._table(n, now) for n in ("extents", "index", "deletes"))
        otype = F.col("otype") if "otype" in objects.columns else F.lit(1)
        rows = objects.select("ext_id", "seq", F.col("payload").cast("binary").alias("payload"), otype.cast("smallint").alias("otype")).withColumn("digest", s.digest("payload")).withColumn("grains", s.grains_of(F.octet_length("payload")))
        guarded = rows.join(extents.select("ext_id", "state"), "ext_id", "left").withColumn("guard", first_error((F.col("state").isNull(), "NotFound")))
        guarded = guarded.withColumn("guard", F.coalesce("guard", write_guard("state"))).drop("state")
        states = extents.select("ext_id", "seg", "cur", "history_next", "snap_idx", "ready")
        results = catalog.put(guarded.where("guard IS NULL").select("ext_id", "seq", "digest", "grains", "otype"), self.config, index, deletes, states)
        refused = guarded.where("guard IS NOT NULL").select("ext_id", "seq", "digest", F.col("grains").cast("long").alias("grains"), "otype", *[F.lit(None).cast("long").alias(c) for c in ("seg", "cur", "history_idx", "addr")], F.col("guard").alias("err"))
        folder = self.store.write("results", results.unionByName(refused))
        done = self.spark.read.parquet(f"{self.store.root}/{folder}")
        ok = done.where("err IS NULL")
        log = ok.join(rows.select("ext_id", "seq", "payload"), ["ext_id", "seq"]).select(*KEY, "grains", "otype", "addr", F.lit(0).cast("long").alias("cycle"), "payload")
        end = done.groupBy("ext_id").agg(F.max("history_idx").alias("h"), F.max_by("seg", F.struct("history_idx", "cur")).alias("s"), F.max_by(F.col("cur") + s.moved_bytes("grains"), F.struct("history_idx", "cur")).alias("c"), F.count_if(F.col("err") == "ExtentFull").alias("full"))
        moved = extents.join(end, "ext_id", "left")
        opened = F.col("h") + 1 - F.col("history_next")
        moved = moved.select(
            "ext_id", "version", F.when(F.col("full") > 0, "Full").otherwise(F.col("state")).alias("state"), "disk_id", F.coalesce("s", "seg").alias("seg"), F.coalesce("c", "cur").alias("cur"),
            F.coalesce(F.col("h") + 1, F.col("history_next")).alias("history_next"), "snap_idx", F.when(opened > 0, F.slice("ready", F.least(opened + 1, F.size("ready") + 1).cast("int"), 256)).otherwise(F.col("ready")).alias("ready"),
        )
        opened = ok.join(extents.select("ext_id", "history_next"), "ext_id").where("history_idx >= history_next").select("ext_id", "seg", "history_idx").distinct().withColumn("opened_ns", F.lit(time.time_ns()).cast("long"))
        self.store.commit(now, replace={"extents": self.store.write("extents", moved)}, append={"history": self.store.write("history", opened), "log": self.store.write("log", log.repartition("ext_id").sortWithinPartitions("ext_id", "addr")), "index": self.store.write("index", ok.select(*[x.split()[0] for x in INDEX.split(", ")]))})
        return done

    def get(self, requests: DataFrame) -> DataFrame:
        """``requests`` (ext_id, digest, offset, n) with piece, crc and err."""
        now = self.store.current()
        guarded = requests.join(self._table("extents", now).select("ext_id", "state"), "ext_id", "left").withColumn("guard", read_guard("state"))
        # the requests find their addresses first, then only those records' payloads are looked for
        asked = self._table("index", now).select(*KEY, "addr").join(requests.select(*KEY).distinct(), KEY, "left_semi")
        live = join_dimension(self._table("log", now).select(*KEY, "addr", "payload"), asked, [*KEY, "addr"])
        out = catalog.get_range(guarded, live)
        return out.select(*requests.columns, "is_full", F.when(F.col("guard").isNull(), F.col("piece")).alias("piece"), F.when(F.col("guard").isNull(), F.col("crc")).alias("crc"), F.coalesce("guard", "err").alias("err"))

    def delete(self, keys: DataFrame, batch: bool = False) -> DataFrame:
        """Delete keys; returns ext_id, digest, addr, grains, err.  Absent keys of a batch are passed over.

        Deletes that no snapshot covers are capped per extent: beyond the cap they are refused until :meth:`snapshot`.
        """
        now = self.store.current()
        index, log, extents = (self._table(n, now) for n in ("index", "deletes", "extents"))
        cap = self.config.batch_delete_cap if batch else self.config.single_delete_cap
        asked = keys.select(*KEY).distinct()
        state = asked.join(extents.select("ext_id", "state"), "ext_id", "left").join(log.groupBy("ext_id").agg(F.count("*").alias("held")), "ext_id", "left").join(index.select(*KEY, "addr", "grains"), KEY, "left")
        n = F.row_number().over(Window.partitionBy("ext_id").orderBy("digest")) + F.coalesce("held", F.lit(0))
        if batch:  # all of an extent's list or none
            n = F.count("*").over(Window.partitionBy("ext_id")) + F.coalesce("held", F.lit(0))
        judged = state.withColumn("err", F.coalesce(modify_guard("state"), first_error((n > cap, "TooManyRequests"), (F.col("addr").isNull() & F.lit(not batch), "NotFound")))).select(*KEY, "addr", "grains", "err")
        folder = self.store.write("results", judged)
        done = self.spark.read.parquet(f"{self.store.root}/{folder}")
        gone = done.where("err IS NULL AND addr IS NOT NULL").select(*KEY)
        stamp = F.lit(time.time_ns()).cast("long")
        self.store.commit(now, replace={"index": self.store.write("index", index.join(gone, KEY, "left_anti"))}, append={"deletes": self.store.write("deletes", gone.withColumn("ts", stamp))})
        return done

    def readdress(self, moves: DataFrame) -> None:
        now = self.store.current()
        moved = catalog.readdress(self._table("index", now), moves).withColumn("seg", s.addr_to_seg("addr", self.config.segment_size))
        self.store.commit(now, replace={"index": self.store.write("index", moved.select(*[x.split()[0] for x in INDEX.split(", ")]))})

    def snapshot(self) -> None:
        """The index as it is becomes what a restart needs: history is covered, the delete log is cleared in the same commit."""
        now = self.store.current()
        extents = self._table("extents", now).withColumn("snap_idx", F.col("history_next") - 1)
        index = self._table("index", now)
        empty = self.spark.createDataFrame([], DELETES)
        self.store.commit(now, replace={"extents": self.store.write("extents", extents), "index": self.store.write("index", index), "deletes": self.store.write("deletes", empty)}, meta={"snap_ts": time.time_ns()})

    def maybe_snapshot(self, force: bool = False) -> bool:
        """Take a snapshot if it is due: ``max_dirty_count`` deletes are held, or its cost by size and age is low enough, or by force."""
        now = self.store.current()
        dirty, live = self._table("deletes", now).count(), self._table("index", now).count()
        age_ms = (time.time_ns() - now["meta"].get("snap_ts", 0)) // 1_000_000
        cost = snapshot.worth_writing(s.snap_bytes(F.lit(live)), F.lit(age_ms), "snap_ts" in now["meta"])
        if not (force or dirty >= self.config.max_dirty_count or self.spark.range(1).select(cost.alias("x")).first().x):
            return False
        self.snapshot()
        return True

    def segments(self) -> DataFrame:
        """Segment states with removed grains, counted from the log (all that was written) and the index (all that is left).

        A segment was sealed when the next one of its extent's history was opened; what collection moved to has no history.
        """
        now = self.store.current()
        size, index = self.config.segment_size, self._table("index", now)
        log = self._table("log", now).select(*KEY, "grains", "addr")
        dead = log.join(index.select(*KEY, "addr"), [*KEY, "addr"], "left_anti")
        removed = dead.groupBy("ext_id", s.addr_to_seg("addr", size).alias("seg")).agg(F.sum(s.moved_grains("grains")).alias("removed"))
        used = log.select("ext_id", s.addr_to_seg("addr", size).alias("seg")).distinct().withColumn("used", F.lit(True))
        every = self._table("extents", now).select("ext_id", F.col("seg").alias("open"), "ready", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("seg"))
        out = every.join(used, ["ext_id", "seg"], "left").join(removed, ["ext_id", "seg"], "left")
        state = F.when(F.col("seg") == F.col("open"), "Writable").when(F.col("used"), "Sealed").when(F.array_contains("ready", F.col("seg").cast("int")), "Ready").otherwise("Reserved")
        following = F.lead("opened_ns").over(Window.partitionBy("ext_id").orderBy("history_idx"))
        last = self._table("history", now).withColumn("sealed_ns", following).groupBy("ext_id", "seg").agg(F.max("history_idx").alias("history_idx"), F.max_by("sealed_ns", "history_idx").alias("sealed_ns"))
        hours = F.coalesce(s.sealed_hours("sealed_ns"), F.lit(0).cast("long"))
        return out.join(last, ["ext_id", "seg"], "left").select("ext_id", "seg", state.alias("state"), hours.alias("sealed_hours"), F.coalesce("removed", F.lit(0).cast("long")).alias("removed"), "history_idx")

    def gc(self, ratio: float | None = None, deep: bool = False) -> DataFrame:
        """Collect all candidates: live objects move to free segments, the sources' records are dropped; returns the moves.

        Segments that no snapshot covers wait: a restart reads them from the log.
        Garbage is always counted from log and index, so a deep run differs only in its ratio: any garbage at all is enough.
        """
        now = self.store.current()
        ratio = 1e-9 if deep else self.config.gc_ratio if ratio is None else ratio
        segments, index, log = self.segments(), self._table("index", now), self._table("log", now)
        behind = segments.join(self._table("extents", now).select("ext_id", "snap_idx"), "ext_id").where("history_idx > snap_idx").select("ext_id", "seg")
        sources = gc.candidates(segments.where("removed > 0"), ratio, self.config.segment_size, unsnapped=behind)
        reserve = gc.next_segment(segments, "Reserved")
        folder = self.store.write("sources", sources.join(reserve.select("ext_id"), "ext_id", "left_semi"))
        sources = self.spark.read.parquet(f"{self.store.root}/{folder}")
        folder = self.store.write("moves", gc.compact(index, sources, self.config, reserve))
        moves = self.spark.read.parquet(f"{self.store.root}/{folder}")
        old = log.withColumn("seg", s.addr_to_seg("addr", self.config.segment_size)).join(sources.select("ext_id", "seg"), ["ext_id", "seg"], "left_anti").drop("seg")
        cycle = F.lit(now["version"]).cast("long")
        copied = moves.join(log.select(*KEY, "addr", "payload"), [*KEY, "addr"]).select(*KEY, "grains", "otype", F.col("new_addr").alias("addr"), cycle.alias("cycle"), "payload")
        after = index.join(moves.select(*KEY, "new_seg", "new_addr"), KEY, "left").withColumn("addr", F.coalesce("new_addr", "addr")).withColumn("seg", F.coalesce("new_seg", "seg")).drop("new_addr", "new_seg")
        # segments that nothing was moved to are ready again, but for one that is the next reserve
        used = moves.groupBy("ext_id").agg(F.collect_set(F.col("new_seg").cast("int")).alias("taken"))
        freed = sources.groupBy("ext_id").agg(F.collect_list(F.col("seg").cast("int")).alias("freed"))
        extents = self._table("extents", now).join(freed, "ext_id", "left").join(used, "ext_id", "left").join(reserve.select("ext_id", F.col("seg").cast("int").alias("dst")), "ext_id", "left")
        spare = F.array_except(F.array_union(F.coalesce("freed", F.array().cast("array<int>")), F.array("dst")), F.coalesce("taken", F.array().cast("array<int>")))
        back = F.array_sort(F.array_except(spare, F.array(F.array_max(spare))))
        extents = extents.withColumn("ready", F.when(F.col("freed").isNull(), F.col("ready")).otherwise(F.array_union("ready", back))).withColumn("state", F.when((F.col("state") == "Full") & (F.size("ready") > 0), READ_WRITE).otherwise(F.col("state"))).drop("freed", "taken", "dst")
        self.store.commit(now, replace={"log": self.store.write("log", old.unionByName(copied)), "index": self.store.write("index", after.select(*[x.split()[0] for x in INDEX.split(", ")])), "extents": self.store.write("extents", extents)})
        return moves

    def clone(self, source: Engine) -> DataFrame:
        """Copy what ``source`` has and this engine lacks; returns progress per extent.  Clones keep ext_id and payload."""
        theirs, mine = source.index, self.index
        plan = clone.copy_plan(theirs, mine, source._table("log"))
        wanted = plan.where("action = 'copy'").select(*KEY)
        rows = theirs.join(wanted, KEY, "left_semi").select(*KEY, "addr", "seq").join(source._table("log").select(*KEY, "addr", "otype", "payload"), [*KEY, "addr"])
        report = clone.progress(plan)
        folder = self.store.write("progress", report)
        self.put(rows.select("ext_id", "seq", "otype", "payload"))
        return self.spark.read.parquet(f"{self.store.root}/{folder}")

    def reconcile(self, response: DataFrame, groups: DataFrame | None = None, versions: list[int] | None = None) -> DataFrame:
        """Apply a heartbeat's answer to the table of extents; returns the actions."""
        now = self.store.current()
        extents = self._table("extents", now)
        folder = self.store.write("actions", reconcile.actions(response, extents, groups, versions))
        todo = self.spark.read.parquet(f"{self.store.root}/{folder}")
        here = extents.join(todo, "ext_id").where("action <> 'delete'")
        here = here.withColumn("state", F.when(F.col("action") == "replace", "Broken").otherwise(F.col("state"))).drop("action")
        drop = todo.where("action IN ('delete', 'replace')").select("ext_id")
        keep = lambda name: self._table(name, now).join(drop, "ext_id", "left_anti")
        self.store.commit(now, replace={"extents": self.store.write("extents", here), "index": self.store.write("index", keep("index")), "log": self.store.write("log", keep("log")), "deletes": self.store.write("deletes", keep("deletes")), "history": self.store.write("history", keep("history"))})
        self.create_extents(todo.where("action = 'create'").join(response.select("ext_id", "version"), "ext_id").select("ext_id", "version", F.lit("").alias("disk_id")))
        return todo
