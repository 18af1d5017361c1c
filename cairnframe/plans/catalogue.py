"""The registered queries over the test tables, each with the SQL whose rows it has.

A query is a function (spark, sf_dir) -> DataFrame over whole tables; ``ORACLE`` has the SQL by the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import catalog, clone, gc, guards, metrics, reconcile, recovery, snapshot
from .views import CAND, CONFIG, DEL, GRAINS, IDX, OBJ, OPS, SEGS, SIZE, WIN, deletes, objects, op_log, placed, sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


PLACED = (OBJ, WIN, IDX)
GARBAGE = (*PLACED, DEL, SEGS)


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ingest, placement, lookup


@query(sql(OBJ, "SELECT ext_id, seq, digest, n_bytes, grains, mov AS moved_bytes FROM obj"))
def objects_ingest(spark, sf_dir):
    return objects(spark, sf_dir).select("ext_id", "seq", "digest", "n_bytes", "grains", s.moved_bytes("grains").alias("moved_bytes"))


@query(sql(OBJ, WIN, "SELECT ext_id, digest, seq, grains FROM win"))
def put_first_wins(spark, sf_dir):
    rows = objects(spark, sf_dir).where(s.moved_bytes("grains") <= SIZE)
    return catalog.first_puts(rows.select("ext_id", "digest", "seq", "grains"))


@query(
    sql(
        *PLACED,
        f"""SELECT obj.ext_id, obj.seq, obj.digest, CASE WHEN obj.mov > {SIZE} THEN 'ObjectTooLarge' WHEN win.seq IS NULL THEN 'ObjDigestExisted' ELSE 'ExtentFull' END AS err
FROM obj LEFT JOIN win ON win.ext_id = obj.ext_id AND win.seq = obj.seq LEFT JOIN idx ON idx.ext_id = obj.ext_id AND idx.seq = obj.seq WHERE idx.seq IS NULL""",
    )
)
def put_rejects(spark, sf_dir):
    return catalog.put(objects(spark, sf_dir), CONFIG).where("err IS NOT NULL").select("ext_id", "seq", "digest", "err")


@query(sql(*PLACED, "SELECT ext_id, seq, digest, grains, seg, cur, history_idx, addr FROM idx"))
def next_fit_placement(spark, sf_dir):
    return placed(spark, sf_dir).select("ext_id", "seq", "digest", "grains", "seg", "cur", "history_idx", "addr")


def _requests(spark, sf_dir):
    """Every object is asked for in the extent of the one 128 further on: about half are not there."""
    return objects(spark, sf_dir).select(s.div(F.col("seq") + 128, 256).alias("ext_id"), "seq", "digest")


@query(
    sql(
        *PLACED,
        """SELECT q.ext_id, q.seq, q.digest, idx.digest IS NOT NULL AS found, idx.addr * 16384 AS "offset", idx.grains * 4096 AS size
FROM (SELECT (seq + 128) // 256 AS ext_id, seq, digest FROM obj) q LEFT JOIN idx ON idx.ext_id = q.ext_id AND idx.digest = q.digest""",
    )
)
def index_lookup(spark, sf_dir):
    return catalog.lookup(_requests(spark, sf_dir), placed(spark, sf_dir))


def _ranges(spark, sf_dir):
    rows = objects(spark, sf_dir)
    first = catalog.first_puts(objects(spark, sf_dir, True).select("ext_id", "digest", "seq", "payload"))
    asked = rows.select("ext_id", "digest", "seq", (F.col("seq") % 97).alias("offset"), (F.col("seq") % 301).alias("n"))
    return catalog.get_range(asked, first)


@query(
    sql(
        OBJ,
        """, first AS (SELECT ext_id, digest, payload, n_bytes FROM obj QUALIFY row_number() OVER (PARTITION BY ext_id, digest ORDER BY seq) = 1)"""[2:],
        """SELECT obj.ext_id, obj.digest, obj.seq, obj.seq % 97 AS "offset", obj.seq % 301 AS n, f.full_ AS is_full, f.err,
  CASE WHEN f.err IS NULL THEN CASE WHEN f.full_ THEN hex(encode(f.payload)) ELSE substr(hex(encode(f.payload)), 2 * (obj.seq % 97) + 1, 2 * (obj.seq % 301)) END END AS piece_hex
FROM obj JOIN (
  SELECT o.ext_id, o.seq, first.payload, (o.seq % 301 = 0 OR (o.seq % 301 = first.n_bytes AND o.seq % 97 = 0)) AS full_,
    CASE WHEN NOT (o.seq % 301 = 0 OR (o.seq % 301 = first.n_bytes AND o.seq % 97 = 0)) AND o.seq % 97 + o.seq % 301 > first.n_bytes THEN 'OutOfRange' END AS err
  FROM obj o JOIN first ON first.ext_id = o.ext_id AND first.digest = o.digest) f ON f.ext_id = obj.ext_id AND f.seq = obj.seq""",
    )
)
def get_range(spark, sf_dir):
    return _ranges(spark, sf_dir).select("ext_id", "digest", "seq", "offset", "n", "is_full", "err", F.hex("piece").alias("piece_hex"))


@query()
def get_range_crc(spark, sf_dir):
    return _ranges(spark, sf_dir).select("ext_id", "seq", "crc", "err")


@query(
    sql(
        OBJ,
        """SELECT ext_id, seq, digest, CASE WHEN seq % 11 = 0 THEN 'ErrUnwritten' WHEN seq % 7 = 0 THEN 'ErrMagic' WHEN seq % 5 = 0 THEN 'ErrChecksum' END AS err,
  (CASE WHEN seq % 13 = 0 THEN ext_id + 1 ELSE ext_id END) <> ext_id AS misdirected FROM obj""",
    )
)
def header_checks(spark, sf_dir):
    rows = objects(spark, sf_dir).withColumn("oid", F.when(F.col("seq") % 11 == 0, 0).otherwise(F.col("seq") + 1))
    rows = rows.withColumn("payload_digest", F.when(F.col("seq") % 5 == 0, F.col("digest") + 1).otherwise(F.col("digest"))).withColumn("hdr_ext_id", F.when(F.col("seq") % 13 == 0, F.col("ext_id") + 1).otherwise(F.col("ext_id")))
    err = guards.header_error("oid", F.col("seq") % 7 != 0, F.col("payload_digest") == F.col("digest"))
    return rows.select("ext_id", "seq", "digest", err.alias("err"), guards.misdirected("hdr_ext_id", "ext_id", F.lit(0), F.lit(0)).alias("misdirected"))


# deletes


@query(sql(*PLACED, DEL, "SELECT DISTINCT del.ext_id, del.digest, idx.digest IS NOT NULL AS found, idx.addr, idx.grains FROM del LEFT JOIN idx ON idx.ext_id = del.ext_id AND idx.digest = del.digest"))
def delete_single(spark, sf_dir):
    return catalog.delete(deletes(spark, sf_dir), placed(spark, sf_dir))[0]


@query(sql(*PLACED, DEL, "SELECT ext_id, digest, addr, grains FROM idx WHERE (ext_id, digest) NOT IN (SELECT (ext_id, digest) FROM del)"))
def delete_batch(spark, sf_dir):
    log = deletes(spark, sf_dir).groupBy("ext_id").agg(F.max("ts").alias("ts"), F.collect_list("digest").alias("digests")).withColumn("kind", F.lit("batch"))
    return catalog.delete(catalog.explode_batches(log), placed(spark, sf_dir))[1].select("ext_id", "digest", "addr", "grains")


@query(
    sql(
        *PLACED,
        DEL,
        f"""SELECT ext_id, seq, digest, CASE WHEN mov > {SIZE} THEN 'ObjectTooLarge' WHEN (ext_id, digest) IN (SELECT (ext_id, digest) FROM del) THEN 'ObjectDirtyDeleted'
  WHEN (ext_id, digest) IN (SELECT (ext_id, digest) FROM idx) THEN 'ObjDigestExisted' ELSE 'other' END AS err FROM obj""",
    )
)
def dirty_reput_reject(spark, sf_dir):
    gone = deletes(spark, sf_dir)
    left = catalog.delete(gone, placed(spark, sf_dir))[1]
    out = catalog.put(objects(spark, sf_dir), CONFIG, left, gone)
    return out.select("ext_id", "seq", "digest", F.coalesce("err", F.lit("other")).alias("err"))


@query(sql(OPS, "SELECT ext_id, seq, CASE WHEN row_number() OVER (PARTITION BY ext_id ORDER BY seq) > 512 THEN 'TooManyRequests' END AS err FROM ops WHERE op = 'delete'"))
def delete_throttle(spark, sf_dir):
    rows = op_log(spark, sf_dir).where("op = 'delete'").select("ext_id", "seq", F.lit(0).alias("epoch"))
    return catalog.throttle(rows, CONFIG.single_delete_cap).select("ext_id", "seq", "err")


@query(sql(OPS, "SELECT ext_id, seq, CASE WHEN row_number() OVER (PARTITION BY ext_id ORDER BY seq DESC) > 512 THEN 'QueueOverflow' END AS err FROM ops"))
def queue_overflow(spark, sf_dir):
    return catalog.keep_newest(op_log(spark, sf_dir).select("ext_id", "seq"), CONFIG.put_pending)


# garbage


@query(sql(*GARBAGE, "SELECT ext_id, seg, removed FROM gone"))
def removed_by_segment(spark, sf_dir):
    return gc.removed_by_segment(placed(spark, sf_dir), deletes(spark, sf_dir), SIZE)


def _segments(spark, sf_dir):
    index = placed(spark, sf_dir)
    return gc.segment_table(index, CONFIG, gc.removed_by_segment(index, deletes(spark, sf_dir), SIZE))


def _candidates(spark, sf_dir):
    """The last snapshot covers history up to the segment before the last sealed one."""
    segments = _segments(spark, sf_dir)
    covered = segments.withColumn("state", F.when(F.col("history_idx") >= F.col("last_idx") - 1, "Behind").otherwise(F.col("state")))
    return gc.candidates(covered, CONFIG.gc_ratio, SIZE)


@query(sql(*GARBAGE, CAND, "SELECT * FROM cand"))
def gc_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gc_candidates(spark, sf_dir)


@query(
    sql(
        *GARBAGE,
        f"""SELECT s.ext_id, s.seg, coalesce(u.used, 0)::BIGINT AS used, ({GRAINS} - coalesce(u.used, 0))::BIGINT AS removed FROM segs s
LEFT JOIN (SELECT ext_id, seg, sum(mov // 4096)::BIGINT AS used FROM idx WHERE (ext_id, digest) NOT IN (SELECT (ext_id, digest) FROM del) GROUP BY ALL) u ON u.ext_id = s.ext_id AND u.seg = s.seg WHERE s.state = 'Sealed'""",
    )
)
def deep_gc_used(spark, sf_dir):
    index, gone = placed(spark, sf_dir), deletes(spark, sf_dir)
    return gc.deep_removed(gc.segment_table(index, CONFIG), catalog.delete(gone, index)[1], SIZE)


@query(
    sql(
        *GARBAGE,
        CAND,
        """live AS (
  SELECT idx.ext_id, digest, grains, mov, addr, rank, row_number() OVER (PARTITION BY idx.ext_id ORDER BY rank, addr) AS rn FROM idx JOIN cand ON cand.ext_id = idx.ext_id AND cand.seg = idx.seg
  WHERE (idx.ext_id, digest) NOT IN (SELECT (ext_id, digest) FROM del)
)""",
        f"""moved AS (
  SELECT *, 0::BIGINT AS dst, 0::BIGINT AS at FROM live WHERE rn = 1
  UNION ALL
  SELECT n.*, CASE WHEN p.at + p.mov + n.mov > {SIZE} THEN p.dst + 1 ELSE p.dst END, CASE WHEN p.at + p.mov + n.mov > {SIZE} THEN 0 ELSE p.at + p.mov END
  FROM moved p JOIN live n ON n.ext_id = p.ext_id AND n.rn = p.rn + 1
)""",
        f"""SELECT m.ext_id, m.digest, m.addr, CASE WHEN m.dst = 0 THEN 255 ELSE c.seg END::BIGINT AS new_seg, (CASE WHEN m.dst = 0 THEN 255 ELSE c.seg END * {SIZE} + m.at) // 16384 AS new_addr
FROM moved m LEFT JOIN cand c ON c.ext_id = m.ext_id AND c.rank = m.dst""",
    )
)
def gc_compaction(spark, sf_dir):
    index = catalog.delete(deletes(spark, sf_dir), placed(spark, sf_dir))[1]
    return gc.compact(index, _candidates(spark, sf_dir), CONFIG).select("ext_id", "digest", "addr", "new_seg", "new_addr")


@query(
    sql(
        *GARBAGE,
        CAND,
        f"SELECT ext_id, seg, CASE WHEN rank > 1 THEN 'Ready' ELSE 'Reserved' END AS state, 1::BIGINT AS cycle, 0::BIGINT AS removed, CASE WHEN rank > 1 THEN {SIZE} ELSE 0 END::BIGINT AS gained FROM cand",
    )
)
def gc_source_done(spark, sf_dir):
    sources = _candidates(spark, sf_dir).withColumn("cycle", F.lit(0).cast("long"))
    reserve = sources.select("ext_id").distinct().withColumn("n_reserved", F.lit(0).cast("long"))  # the reserve is what was copied to
    return gc.source_done(sources, reserve, CONFIG)


@query(sql(*GARBAGE, f"SELECT ext_id, count(*) FILTER (state = 'Ready') AS n_ready, count(*) FILTER (state = 'Reserved') AS n_reserved, count(*) FILTER (state = 'Writable') AS n_writable, count(*) FILTER (state = 'Sealed') AS n_sealed, count(*) FILTER (state = 'Ready') * {SIZE} AS avail FROM segs GROUP BY ext_id"))
def segment_state_counts(spark, sf_dir):
    return gc.state_counts(_segments(spark, sf_dir), SIZE)


@query(sql(*GARBAGE, "SELECT ext_id, min(seg) FILTER (state = 'Ready') AS ready, min(seg) FILTER (state = 'Reserved') AS reserved, count(*) FILTER (state = 'Reserved') > 1 AS enough FROM segs GROUP BY ext_id"))
def next_segments(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    ready, reserved = (gc.next_segment(segments, x).withColumnRenamed("seg", x.lower()) for x in ("Ready", "Reserved"))
    return gc.reserve_enough(segments, CONFIG).join(ready, "ext_id", "left").join(reserved, "ext_id", "left").select("ext_id", "ready", "reserved", "enough")


@query(sql(*GARBAGE, "SELECT ext_id, seg, state, removed, coalesce(sealed_hours, -1) AS sealed_hours FROM segs"))
def extent_header_segments(spark, sf_dir):
    """The arrays of an extent's header, taken apart again."""
    rows = F.sort_array(F.collect_list(F.struct("seg", "state", "removed", F.coalesce("sealed_hours", F.lit(-1).cast("long")).alias("sealed_hours"))))
    headers = _segments(spark, sf_dir).groupBy("ext_id").agg(rows.alias("a"))
    headers = headers.select("ext_id", *[F.col("a").getField(n).alias(n) for n in ("state", "removed", "sealed_hours")])
    out = headers.select("ext_id", F.posexplode(F.arrays_zip("state", "removed", "sealed_hours")).alias("seg", "z"))
    return out.select("ext_id", F.col("seg").cast("long").alias("seg"), "z.state", "z.removed", "z.sealed_hours")


# snapshots and recovery


@query("SELECT o_custkey AS ext_id, max(o_orderkey) AS snap_ts, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY o_custkey")
def snapshot_latest(spark, sf_dir):
    return snapshot.latest(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ext_id"), F.col("o_orderkey").alias("snap_ts"), F.col("o_orderpriority").alias("label")))


@query("SELECT o_custkey AS ext_id, o_orderkey AS snap_ts FROM orders o WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def snapshot_superseded(spark, sf_dir):
    return snapshot.superseded(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ext_id"), F.col("o_orderkey").alias("snap_ts")))


@query("SELECT l_suppkey AS ext_id, count(*) AS obj_cnt, (count(*) + 3638) // 3639 AS blocks, 4096 + (count(*) + 3638) // 3639 * 32768 AS n_bytes FROM lineitem GROUP BY l_suppkey")
def snapshot_blocks(spark, sf_dir):
    return snapshot.sizes(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ext_id")))


@query(sql(*PLACED, "SELECT ext_id, digest, 1::BIGINT AS otype, grains, addr, addr % 256 AS e1 FROM idx"))
def snapshot_entry_codec(spark, sf_dir):
    rows = placed(spark, sf_dir).select("ext_id", s.make_snap_entry("digest", "otype", "grains", "addr").alias("e"))
    return rows.select("ext_id", s.parse_snap_entry("e.e0", "e.e1").alias("x"), "e.e1").select("ext_id", "x.*", "e1")


@query(sql(*PLACED, "SELECT ext_id, digest // 65536 AS tag, seq % 64 AS neigh_off, 1::BIGINT AS otype, grains, addr FROM idx"))
def entry_codec(spark, sf_dir):
    rows = placed(spark, sf_dir).select("ext_id", s.make_entry("digest", F.col("seq") % 64, "otype", "grains", "addr").alias("e"))
    return rows.select("ext_id", s.parse_entry("e").alias("x")).select("ext_id", "x.*")


@query(sql(OBJ, "SELECT seq, digest, digest & 65535 AS slot, digest AS rebuilt FROM obj"))
def digest_rebuild(spark, sf_dir):
    cap = s.adjust_cap(F.lit(40000))
    rows = objects(spark, sf_dir).select("seq", "digest", s.calc_slot(cap, "digest").alias("slot"), (F.col("seq") % 64).alias("off"), s.make_tag("digest")["tag"].alias("tag"))
    return rows.select("seq", "digest", "slot", s.back_to_digest("tag", cap, F.col("slot") + F.col("off"), "off").alias("rebuilt"))


@query("SELECT o_orderkey, round((2 + 0.25 * pow(o_totalprice, 0.618)) * exp(-0.000618 * (o_orderkey % 20000)), 6) AS cost, round((2 + 0.25 * pow(o_totalprice, 0.618)) * exp(-0.000618 * (o_orderkey % 20000)), 6) < 2 AS acceptable FROM orders")
def snapshot_cost(spark, sf_dir):
    cost = F.round(s.snap_cost("o_totalprice", F.col("o_orderkey") % 20000), 6)
    return table(spark, sf_dir, "orders").select("o_orderkey", cost.alias("cost"), (cost < snapshot.COST_LIMIT).alias("acceptable"))


@query("SELECT event_id, (epoch_us(ts) * 1000 - 1616988479613927876) // 3600000000000 AS hours, (epoch_us(ts) * 1000 - 1616988479613927876) // 3600000000000 * 3600000000000 + 1616988479613927876 AS ns FROM events")
def sealed_hours(spark, sf_dir):
    hours = s.sealed_hours(F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    return table(spark, sf_dir, "events").select("event_id", hours.alias("hours")).withColumn("ns", s.sealed_ns("hours"))


@query(
    sql(
        *PLACED,
        DEL,
        """snap AS (SELECT ext_id, max(history_idx) - 1 AS h, 65536 AS c, max(seq) - 200 AS hlc FROM idx GROUP BY ext_id)""",
        """SELECT idx.ext_id, digest, addr, grains, CASE WHEN history_idx > h OR (history_idx = h AND cur >= c) THEN 'log' ELSE 'snapshot' END AS origin FROM idx JOIN snap USING (ext_id)
WHERE NOT EXISTS (SELECT 1 FROM del WHERE del.ext_id = idx.ext_id AND del.digest = idx.digest AND del.ts >= hlc)""",
    )
)
def recovery_merge(spark, sf_dir):
    log = placed(spark, sf_dir)
    snap = log.groupBy("ext_id").agg((F.max("history_idx") - 1).alias("history_idx"), F.lit(65536).cast("long").alias("cur"), (F.max("seq") - 200).alias("hlc_ts"))
    tail = recovery.log_tail(log, snap)
    old = log.join(tail, ["ext_id", "digest"], "left_anti")
    return recovery.recover(old, tail, deletes(spark, sf_dir), snap).select("ext_id", "digest", "addr", "grains", "origin")


@query(sql(*PLACED, f"SELECT ext_id, digest, addr FROM idx WHERE NOT (seg = 1 AND addr >= ({SIZE} + 65536) // 16384)"))
def gc_truncation(spark, sf_dir):
    index = placed(spark, sf_dir)
    at = index.select("ext_id").distinct().select("ext_id", F.lit(1).cast("long").alias("gc_dst"), F.lit(65536).cast("long").alias("gc_dst_cur"))
    return recovery.gc_truncated(index, at, SIZE).select("ext_id", "digest", "addr")


def _cycled(spark, sf_dir):
    """The log with record cycles as a reclaimed segment would have them: most of this cycle, some left from the last, a few beyond."""
    cycle = F.when(F.col("digest") % 16 == 0, 0).when(F.col("digest") % 64 == 1, 2).otherwise(1).cast("long")
    return placed(spark, sf_dir).withColumn("cycle", cycle).withColumn("seg_cycle", F.lit(1).cast("long"))


@query(
    sql(
        *PLACED,
        """cyc AS (SELECT *, CASE WHEN digest % 16 = 0 THEN 0 WHEN digest % 64 = 1 THEN 2 ELSE 1 END AS cycle FROM idx)""",
        """SELECT c.ext_id, c.seg, c.digest, c.cur, CASE WHEN cycle > 1 THEN 'ExtentBroken' END AS err FROM cyc c
LEFT JOIN (SELECT ext_id, seg, min(cur) AS e FROM cyc WHERE cycle < 1 GROUP BY ALL) z ON z.ext_id = c.ext_id AND z.seg = c.seg WHERE e IS NULL OR cur < e""",
    )
)
def cycle_filter(spark, sf_dir):
    return recovery.live_records(_cycled(spark, sf_dir)).select("ext_id", "seg", "digest", "cur", "err")


@query(
    sql(
        *PLACED,
        """ends AS (SELECT ext_id, seg, history_idx, coalesce(min(CASE WHEN digest % 16 = 0 THEN cur END), max(cur + mov)) AS "end", arg_min(mov, cur) AS first_bytes FROM idx GROUP BY ALL)""",
        """nxt AS (SELECT *, lead(first_bytes) OVER (PARTITION BY ext_id ORDER BY history_idx) AS next_bytes FROM ends)""",
        f"""SELECT ext_id, seg, "end", next_bytes, CASE WHEN {SIZE} - "end" > 147456 THEN 'LostWrite' WHEN "end" + next_bytes <= {SIZE} THEN 'ExtentBroken' END AS err FROM nxt WHERE next_bytes IS NOT NULL""",
    )
)
def lost_write_check(spark, sf_dir):
    ends = recovery.segment_ends(placed(spark, sf_dir), F.col("digest") % 16 != 0)
    return recovery.lost_writes(ends, SIZE, max_object=140000)


@query("SELECT o_orderkey, o_orderkey % 700 - 256 >= o_custkey % 500 AS behind, (o_orderkey % 3 = o_custkey % 3 AND nullif(o_orderkey % 2, 0) IS NOT DISTINCT FROM nullif(o_custkey % 2, 0)) AS caught_up FROM orders")
def snapshot_position(spark, sf_dir):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    pairs = [(a % 3, b % 3), (F.nullif(a % 2, F.lit(0)), F.nullif(b % 2, F.lit(0)))]
    return table(spark, sf_dir, "orders").select("o_orderkey", guards.snapshot_behind(a % 700, b % 500).alias("behind"), guards.snapshot_caught_up(pairs).alias("caught_up"))


# addresses


@query(sql(OPS, "SELECT digest, max(seq) AS addr FROM ops WHERE op IN ('put', 'readdress') GROUP BY digest"))
def last_address_wins(spark, sf_dir):
    moves = op_log(spark, sf_dir).where("op IN ('put', 'readdress')").select("digest", F.col("new_addr").alias("addr"), "seq").withColumn("ext_id", F.lit(0))
    index = moves.select("ext_id", "digest").distinct().withColumn("addr", F.lit(-1).cast("long"))
    return catalog.readdress(index, moves).select("digest", "addr")


@query("SELECT coalesce(c_custkey, k) AS digest, CASE WHEN c_custkey IS NULL THEN 7 ELSE c_nationkey END::BIGINT AS grains, coalesce(a, c_custkey) AS addr FROM customer FULL JOIN (SELECT o_custkey * 2 AS k, max(o_orderkey) AS a FROM orders GROUP BY 1) ON k = c_custkey")
def upsert_addr(spark, sf_dir):
    zero = F.lit(0).cast("long")
    index = table(spark, sf_dir, "customer").select(zero.alias("ext_id"), F.col("c_custkey").alias("digest"), F.lit(1).alias("otype"), F.col("c_nationkey").cast("long").alias("grains"), F.col("c_custkey").alias("addr"))
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 2).alias("digest")).agg(F.max("o_orderkey").alias("addr")).select(zero.alias("ext_id"), "digest", F.lit(1).alias("otype"), F.lit(7).cast("long").alias("grains"), "addr")
    return catalog.upsert(index, rows).select("digest", "grains", "addr")


@query("SELECT (i * 2654435761 + 12345) % 4294967296 AS digest, i % 3 + 1 AS otype, i % 2046 + 1 AS grains, i % 16777216 AS addr FROM range(66560) t(i)")
def synthetic_entries(spark, sf_dir):
    return catalog.synthetic_entries(spark, (1 << 16) + 1024).select("digest", *_long("otype", "grains", "addr"))


# cloning


@query(sql(*PLACED, "SELECT ext_id, (rn - 1) // 100 AS piece, count(*) AS n, min(digest) AS first_digest, max(digest) AS last_digest, count(*) * 8 AS n_bytes FROM (SELECT ext_id, digest, row_number() OVER (PARTITION BY ext_id ORDER BY digest) AS rn FROM idx) GROUP BY ALL"))
def clone_export_chunks(spark, sf_dir):
    return clone.export_chunks(placed(spark, sf_dir), 100)


@query(sql(*PLACED, "ex AS (SELECT DISTINCT ext_id FROM obj UNION SELECT 1000000)", "SELECT ex.ext_id, count(idx.digest) AS total, CASE WHEN count(idx.digest) = 0 THEN 'Nop' WHEN count(idx.digest) <= 200 THEN 'Normal' ELSE 'Link' END AS kind FROM ex LEFT JOIN idx ON idx.ext_id = ex.ext_id GROUP BY ex.ext_id"))
def clone_export_summary(spark, sf_dir):
    every = objects(spark, sf_dir).select("ext_id").distinct().union(spark.sql("SELECT 1000000L AS ext_id"))
    return clone.export_summary(every, placed(spark, sf_dir), 200)


@query(sql(OBJ, WIN, "SELECT ext_id, digest FROM win WHERE (ext_id, digest) NOT IN (SELECT (ext_id, digest) FROM obj WHERE seq % 3 = 0)"))
def clone_missing(spark, sf_dir):
    source = objects(spark, sf_dir)
    return clone.missing(source.where(s.moved_bytes("grains") <= SIZE).select("ext_id", "digest").distinct(), source.where("seq % 3 = 0"))


@query(
    sql(
        OBJ,
        """keys AS (SELECT DISTINCT ext_id, digest FROM obj)""",
        """act AS (SELECT ext_id, CASE WHEN (ext_id, digest) IN (SELECT (ext_id, digest) FROM obj WHERE seq % 3 = 0) THEN 'present' WHEN (ext_id, digest) IN (SELECT (ext_id, digest) FROM obj WHERE seq % 5 <> 0) THEN 'copy' ELSE 'absent' END AS action FROM keys)""",
        "SELECT ext_id, count(*) AS total, count(*) FILTER (action <> 'absent') AS done, count(*) FILTER (action = 'absent') AS missing, 'Done' AS state FROM act GROUP BY ext_id",
    )
)
def clone_copy(spark, sf_dir):
    source = objects(spark, sf_dir)
    return clone.progress(clone.copy_plan(source, source.where("seq % 3 = 0"), source.where("seq % 5 <> 0")))


# control plane


def _response(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("ext_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "Broken").otherwise("ReadWrite").alias("state"), F.col("c_nationkey").alias("created"), (F.col("c_custkey") % 4).cast("int").alias("group_id"),
        (F.col("c_custkey") % 3 + 1).cast("int").alias("version"), (F.col("c_mktsegment") == "BUILDING").alias("new_source"),
    )


@query(
    """SELECT coalesce(c_custkey, k) AS ext_id, CASE WHEN c_custkey IS NULL THEN 'delete' WHEN k IS NULL AND c_nationkey = 0 AND c_custkey % 4 < 3 AND c_custkey % 3 + 1 IN (1, 2) THEN 'create' WHEN k IS NULL AND c_nationkey = 0 THEN 'skip'
  WHEN k IS NULL THEN 'broken' WHEN c_mktsegment = 'MACHINERY' THEN 'replace' WHEN c_mktsegment = 'BUILDING' THEN 'clone_source' ELSE 'update' END AS action
FROM customer FULL JOIN (SELECT DISTINCT o_custkey * 3 // 2 AS k FROM orders) ON k = c_custkey"""
)
def reconcile_actions(spark, sf_dir):
    local = table(spark, sf_dir, "orders").select(s.div(F.col("o_custkey") * 3, 2).alias("ext_id"))
    groups = spark.range(3).select(F.col("id").cast("int").alias("group_id"))
    return reconcile.actions(_response(spark, sf_dir), local, groups, [1, 2])


def _extents(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("ext_id"), F.when(F.col("c_mktsegment") == "MACHINERY", "Broken").when(F.col("c_mktsegment") == "BUILDING", "Full").otherwise("ReadWrite").alias("state"), F.col("c_nationkey").cast("string").alias("disk_id"), F.floor(F.col("c_custkey") * 4096).alias("avail"))


def _disks(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    state = F.when(F.col("n_regionkey") == 0, "Broken").when(F.col("n_regionkey") == 1, "Tombstone").otherwise("ReadWrite")
    return n.select(F.col("n_nationkey").cast("string").alias("disk_id"), state.alias("state"), F.lit(8 << 40).cast("long").alias("size"), (F.col("n_nationkey").cast("long") * F.lit(350 << 30)).alias("used"))


@query(
    """SELECT o_orderkey, o_custkey * 2 AS ext_id, CASE WHEN o_orderkey % 5 <> 1 THEN 'BadRequest' WHEN c_custkey IS NULL THEN 'NotFound' WHEN c_mktsegment = 'MACHINERY' THEN 'ExtentBroken' WHEN n_regionkey = 0 THEN 'DiskBroken' WHEN n_regionkey = 1 THEN 'DiskTombstone' END AS err
FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2 LEFT JOIN nation ON n_nationkey = c_nationkey"""
)
def request_guard(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("ext_id"), (F.col("o_orderkey") % 5).alias("group_id"))
    return guards.request_guard(asked, _extents(spark, sf_dir), _disks(spark, sf_dir), "Up", 1).select("o_orderkey", "ext_id", "err")


@query(
    """SELECT n_nationkey::VARCHAR AS disk_id, CASE n_regionkey WHEN 0 THEN 'Broken' WHEN 1 THEN 'Tombstone' ELSE 'ReadWrite' END AS state, 8796093022208 AS size, n_nationkey::BIGINT * 375809638400 AS used,
  coalesce(n, 0) AS n_extents, coalesce(a, 0)::BIGINT AS avail, coalesce(b, 0) AS n_broken FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, sum(c_custkey * 4096) AS a, count(*) FILTER (c_mktsegment = 'MACHINERY') AS b FROM customer GROUP BY 1) ON c_nationkey = n_nationkey"""
)
def server_heartbeat(spark, sf_dir):
    return reconcile.heartbeat(_disks(spark, sf_dir), _extents(spark, sf_dir))


@query("SELECT c_custkey AS ext_id, CASE WHEN c_mktsegment = 'MACHINERY' OR n_regionkey = 0 THEN 'Broken' WHEN k IS NOT NULL THEN 'Sealed' WHEN c_mktsegment = 'BUILDING' THEN 'Full' ELSE 'ReadWrite' END AS state FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) ON k = c_custkey")
def extent_state_updates(spark, sf_dir):
    told = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ext_id")).distinct().withColumn("state", F.lit("Sealed"))
    sick = reconcile.broken_disks(_extents(spark, sf_dir), _disks(spark, sf_dir))
    return reconcile.meta_update(sick, told).select("ext_id", "state")


@query(
    """SELECT o_orderkey, CASE WHEN e = 'DiskBroken' OR e = 'ExtentBroken' THEN 'Broken' WHEN e = 'ExtentFull' AND st <> 'Broken' THEN 'Full' ELSE st END AS after_, CASE st WHEN 'Broken' THEN 'ExtentBroken' WHEN 'Clone' THEN 'ExtentClone' END AS read_err,
  CASE WHEN st = 'Broken' THEN 'ExtentBroken' WHEN st = 'Full' THEN 'ExtentFull' WHEN st = 'Sealed' THEN 'ExtentSealed' WHEN st = 'Clone' AND NOT c THEN 'ExtentClone' WHEN st <> 'Clone' AND c THEN 'ExtentNotClone' END AS write_err, CASE WHEN st = 'Broken' THEN 'ExtentBroken' END AS modify_err
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ReadWrite' WHEN 1 THEN 'Full' WHEN 2 THEN 'Sealed' WHEN 3 THEN 'Clone' ELSE 'Broken' END AS st, CASE o_custkey % 4 WHEN 0 THEN 'DiskBroken' WHEN 1 THEN 'ExtentBroken' WHEN 2 THEN 'ExtentFull' END AS e, o_custkey % 2 = 0 AS c FROM orders)"""
)
def state_guards(spark, sf_dir):
    o, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    st = F.when(o == 0, "ReadWrite").when(o == 1, "Full").when(o == 2, "Sealed").when(o == 3, "Clone").otherwise("Broken")
    err = F.when(c % 4 == 0, "DiskBroken").when(c % 4 == 1, "ExtentBroken").when(c % 4 == 2, "ExtentFull")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", st.alias("st"), err.alias("e"), (c % 2 == 0).alias("c"))
    return rows.select("o_orderkey", guards.state_after("st", "e").alias("after_"), guards.read_guard("st").alias("read_err"), guards.write_guard("st", "c").alias("write_err"), guards.modify_guard("st").alias("modify_err"))


_SNAP = s.max_snapshot_bytes(1 << 30)
_EXTENT = s.extent_bytes(1 << 30)


@query(f"SELECT n_nationkey::VARCHAR AS disk_id, 8796093022208 - n_nationkey::BIGINT * 375809638400 AS free, CASE WHEN {256 * (1 << 30) + 4096 + 4096 + 2 * _SNAP + (4 << 20)} > 8796093022208 - n_nationkey::BIGINT * 375809638400 THEN 'NoSpace' END AS err FROM nation")
def space_accounting(spark, sf_dir):
    return reconcile.fits(_disks(spark, sf_dir), _EXTENT).select("disk_id", "free", "err")


@query("SELECT c_custkey AS ext_id, '/data/disk_' || c_nationkey || '/ext_' || c_custkey AS dir, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS parsed FROM customer")
def extent_dirs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ext_id"), s.ext_dir(F.concat(F.lit("/data/disk_"), F.col("c_nationkey").cast("string")), "c_custkey").alias("dir"))
    named = F.when(F.col("ext_id") % 10 == 0, F.regexp_replace("dir", "ext_", "old_")).otherwise(F.col("dir"))
    return c.select("ext_id", "dir", s.ext_id_of(named).alias("parsed"))


# reports


def _samples(spark, sf_dir):
    first = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return op_log(spark, sf_dir).select("op", ((F.col("t_us") - first) * 1000).alias("t_ns"), F.round(F.col("value") * 1000).cast("long").alias("latency_ns"), (F.col("seq") % 20 != 0).alias("ok"))


_SAMPLES = """samples AS (SELECT op, (t_us - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS t_ns, round(value * 1000)::BIGINT AS latency_ns, seq % 20 <> 0 AS ok FROM ops)"""
SKIP_NS = 3_600_000_000_000


@query(
    sql(
        OPS,
        _SAMPLES,
        f"""SELECT op, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed, min(latency_ns) FILTER (t_ns > {SKIP_NS}) AS min_ns, round(avg(latency_ns) FILTER (t_ns > {SKIP_NS}), 3) AS mean_ns, max(latency_ns) FILTER (t_ns > {SKIP_NS}) AS max_ns, count(*) / (60000000000 / 1e9) AS iops FROM samples GROUP BY op""",
    )
)
def perf_summary(spark, sf_dir):
    return metrics.summary(_samples(spark, sf_dir), SKIP_NS, F.lit(60_000_000_000)).withColumn("mean_ns", F.round("mean_ns", 3))


@query(
    sql(
        OPS,
        _SAMPLES,
        f"""SELECT op, p::DOUBLE AS pct, round(list_extract(q, i), 3) AS value FROM (SELECT op, quantile_cont(latency_ns::DOUBLE, [{", ".join(str(q / 100) for q in metrics.QUANTILES)}]) AS q FROM samples WHERE t_ns > {SKIP_NS} GROUP BY op),
  (SELECT unnest([{", ".join(str(float(q)) for q in metrics.QUANTILES)}]) AS p, unnest(range(1, {len(metrics.QUANTILES) + 1})) AS i)""",
    )
)
def perf_quantiles(spark, sf_dir):
    return metrics.quantiles(_samples(spark, sf_dir), SKIP_NS).withColumn("value", F.round("value", 3))


@query("SELECT clock, count(*) AS n, count(*) FILTER (ts < b) AS n_jumps FROM (SELECT o_custkey AS clock, epoch_us(o_orderdate) AS ts, lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) GROUP BY clock")
def clock_jump(spark, sf_dir):
    return metrics.clock_jumps(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clock"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_orderkey").alias("seq")))


@query("SELECT round(avg(load), 6) AS avg_load, min(load) AS min_load, arg_min(cap, load * 100000 + cap) AS min_cap, max(load) AS max_load, arg_max(cap, load * 100000 - cap) AS max_cap FROM (SELECT p_partkey AS cap, p_retailprice AS load FROM part)")
def load_factor(spark, sf_dir):
    runs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cap"), F.col("p_retailprice").alias("load"))
    return metrics.load_factor(runs).withColumn("avg_load", F.round("avg_load", 6))


@query(sql(*PLACED, "SELECT ext_id, digest, row_number() OVER (PARTITION BY ext_id ORDER BY md5('perf' || digest), digest) AS rn FROM idx"))
def shuffled_order(spark, sf_dir):
    return catalog.shuffled(placed(spark, sf_dir).select("ext_id", "digest"), "perf").withColumn("rn", F.col("rn").cast("long"))


@query(sql(OBJ, "SELECT DISTINCT e AS ext_id, digest FROM obj, range(4) t(e)"))
def perf_preload(spark, sf_dir):
    """The same objects for each of four extents."""
    digests = objects(spark, sf_dir).select("digest").distinct()
    return digests.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("ext_id"), "digest")


# the update log as a stream

_STATE = """
SELECT ext_id, digest, coalesce(arg_max(op = 'put', seq) FILTER (op <> 'readdress'), false) AS present,
  CASE WHEN coalesce(arg_max(op = 'put', seq) FILTER (op <> 'readdress'), false) THEN arg_max(new_addr, seq) FILTER ((op = 'put' AND NOT was) OR (op = 'readdress' AND was)) END AS addr,
  count(*) FILTER (op = 'put' AND NOT was) AS n_put, count(*) FILTER (op = 'put' AND was) AS n_rejected, count(*) FILTER (op = 'delete' AND was) AS n_deleted, count(*) FILTER (op = 'readdress' AND was) AS n_moved,
  count(*) FILTER (op <> 'put' AND NOT was) AS n_missing
FROM (
  SELECT *, coalesce(last_value(CASE WHEN op <> 'readdress' THEN op END IGNORE NULLS) OVER (PARTITION BY ext_id, digest ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'put', false) AS was FROM ops WHERE op <> 'get'
) GROUP BY ext_id, digest"""


@query(sql(OPS, _STATE))
def batch_index_state(spark, sf_dir):
    from ..streaming import index_state

    return index_state.batch_state(op_log(spark, sf_dir))


@query(sql(OPS, _STATE))
def stream_index_state(spark, sf_dir):
    from ..sources.scratch import scratch_path
    from ..streaming import index_state

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    op = F.when(F.col("event_type") == "purchase", "put").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "readdress").otherwise("get")
    ops = events.select((F.col("user_id") % 3).alias("ext_id"), F.col("user_id").alias("digest"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").alias("new_addr"))
    out = scratch_path(spark, "index-state")
    index_state.start(ops, f"{out}/states", f"{out}/checkpoint").awaitTermination()
    return index_state.newest(spark, f"{out}/states")


from . import files  # noqa: E402, F401  (its queries register themselves)
