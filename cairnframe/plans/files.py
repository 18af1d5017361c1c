"""Queries that go through the binary files of extents: written in the shared folder, read back, compared with SQL on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ExtentConfig, PerfConfig, ServerConfig
from ..functions import scalars as s
from ..operators import clone, gc
from ..sources import extents as files
from ..sources.scratch import scratch_path
from .catalogue import GARBAGE, PLACED, _segments, query
from .views import CONFIG, DEL, GRAINS, OBJ, SIZE, deletes, objects, placed, sql


def _extents(spark, sf_dir):
    return objects(spark, sf_dir).select("ext_id").distinct().select("ext_id", (F.col("ext_id") % 5 + 1).cast("int").alias("version"))


def _folder(spark, sf_dir):
    """The files of fresh extents."""
    root = scratch_path(spark, "extents")
    files.write_extents(_extents(spark, sf_dir), root, SIZE).write.format("noop").mode("overwrite").save()
    return root


@query(sql(OBJ, "SELECT DISTINCT ext_id, (ext_id % 5 + 1)::INT AS version, NULL::VARCHAR AS err FROM obj"))
def extents_listed(spark, sf_dir):
    return files.list_extents(spark, [_folder(spark, sf_dir)]).select("ext_id", "version", "err")


@query(sql(OBJ, "SELECT ext_id, seg, CASE seg WHEN 0 THEN 2 WHEN 255 THEN 1 ELSE 0 END AS state, 0::BIGINT AS removed, 0::BIGINT AS cycle FROM (SELECT DISTINCT ext_id FROM obj) CROSS JOIN (SELECT unnest(range(256)) AS seg)"))
def extent_header_files(spark, sf_dir):
    return files.segments_of(files.read_headers(spark, [_folder(spark, sf_dir)])).select("ext_id", "seg", "state", "removed", "cycle")


@query(sql(*PLACED, "SELECT ext_id, digest, 1 AS otype, grains, addr, 7 AS snap_ts FROM idx"))
def snapshot_files(spark, sf_dir):
    root = scratch_path(spark, "snapshots")
    index = placed(spark, sf_dir)
    states = index.groupBy("ext_id").agg(F.max("history_idx").alias("history_idx"), F.max("cur").alias("cur")).withColumn("snap_ts", F.lit(7).cast("long"))
    files.write_snapshots(index, states, root).write.format("noop").mode("overwrite").save()
    return files.read_snapshots(spark, [root]).select("ext_id", "digest", "otype", "grains", "addr", F.col("snap_ts").cast("int").alias("snap_ts"))


@query(sql(OBJ, DEL, "SELECT ext_id, CASE WHEN count(*) = 1 THEN 'single' ELSE 'batch' END AS kind, min(ts) AS ts, count(*) AS n, min(digest) AS first, max(digest) AS last FROM del GROUP BY ext_id"))
def delete_log_files(spark, sf_dir):
    root = scratch_path(spark, "deletes")
    log = deletes(spark, sf_dir).groupBy("ext_id").agg(F.min("ts").alias("ts"), F.array_sort(F.collect_list("digest")).alias("digests")).withColumn("kind", F.when(F.size("digests") == 1, "single").otherwise("batch"))
    files.write_deletes(log, root).write.format("noop").mode("overwrite").save()
    return files.read_deletes(spark, [root]).select("ext_id", "kind", "ts", F.size("digests").cast("long").alias("n"), F.array_min("digests").alias("first"), F.array_max("digests").alias("last"))


@query(sql(*PLACED, "SELECT ext_id, seg, cur, digest, 1 AS otype, grains, seg % 3 AS cycle, grains * 4096 AS n_bytes, NULL::VARCHAR AS err FROM idx WHERE seg % 4 <> 3 AND cur >= CASE WHEN seg = 1 THEN 32768 ELSE 0 END"))
def segment_files(spark, sf_dir):
    """Records written at their cursors, and read again from a cursor on; segments of an older cycle than asked for give nothing."""
    root = scratch_path(spark, "segments")
    log = placed(spark, sf_dir).join(objects(spark, sf_dir, payload=True).select("ext_id", "seq", "payload"), ["ext_id", "seq"]).withColumn("cycle", F.col("seg") % 3)
    files.write_segments(log, root).write.format("noop").mode("overwrite").save()
    asked = placed(spark, sf_dir).select("ext_id", "seg").distinct()
    asked = asked.select("ext_id", "seg", F.when(F.col("seg") == 1, 32768).otherwise(0).cast("long").alias("cur"), (F.col("seg") % 3 + (F.col("seg") % 4 == 3).cast("int")).cast("long").alias("cycle"))
    # a cursor that is no record's is moved to the next record
    starts = log.join(asked.select("ext_id", "seg", F.col("cur").alias("at")), ["ext_id", "seg"]).where("cur >= at").groupBy("ext_id", "seg").agg(F.min("cur").alias("first"))
    asked = asked.join(starts, ["ext_id", "seg"]).select("ext_id", "seg", F.col("first").alias("cur"), "cycle")
    out = files.read_segments(asked, root)
    return out.select("ext_id", "seg", "cur", "digest", "otype", "grains", "cycle", F.octet_length("payload").cast("long").alias("n_bytes"), "err")


@query(sql(*PLACED, "SELECT ext_id, piece, count(*) AS n, md5(string_agg(digest::VARCHAR, ',' ORDER BY digest)) AS list FROM (SELECT ext_id, digest, (row_number() OVER (PARTITION BY ext_id ORDER BY digest) - 1) // 100 AS piece FROM idx) GROUP BY ALL"))
def clone_oid_lists(spark, sf_dir):
    root = scratch_path(spark, "oids")
    files.write_oid_lists(clone.export_pieces(placed(spark, sf_dir), 100), root).write.format("noop").mode("overwrite").save()
    return files.read_oid_lists(spark, [root]).select("ext_id", "piece", F.size("digests").cast("long").alias("n"), F.md5(F.array_join(F.transform("digests", lambda x: x.cast("string")), ",").cast("binary")).alias("list"))


UNSNAPPED = "unsnapped AS (SELECT ext_id, seg FROM segs WHERE history_idx > last_idx - 3)"
LEAST = int(GRAINS * CONFIG.gc_ratio)


def _unsnapped(segments):
    """Segments of the history that the last snapshot, three back, does not cover."""
    return segments.where(F.col("history_idx") > F.col("last_idx") - 3)


@query(sql(*GARBAGE, UNSNAPPED, f"SELECT ext_id, seg, removed, sealed_hours, row_number() OVER (PARTITION BY ext_id ORDER BY removed DESC, sealed_hours, seg) AS rank FROM segs WHERE state = 'Sealed' AND removed >= {LEAST} AND (ext_id, seg) NOT IN (SELECT (ext_id, seg) FROM unsnapped)"))
def gc_candidates_unsnapped(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    return gc.candidates(segments, CONFIG.gc_ratio, SIZE, unsnapped=_unsnapped(segments))


@query(
    sql(
        *GARBAGE,
        UNSNAPPED,
        "unfinished AS (SELECT ext_id, max(seg) AS seg FROM segs WHERE state = 'Sealed' AND ext_id % 2 = 0 GROUP BY ext_id)",
        f"""ok AS (SELECT ext_id, seg, removed, sealed_hours FROM segs WHERE state = 'Sealed' AND removed >= {LEAST} AND (ext_id, seg) NOT IN (SELECT (ext_id, seg) FROM unsnapped) AND (ext_id, seg) NOT IN (SELECT (ext_id, seg) FROM unfinished)
  UNION ALL SELECT ext_id, seg, {GRAINS}::BIGINT, 0::BIGINT FROM unfinished)""",
        "SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY removed DESC, sealed_hours, seg) AS rank FROM ok",
    )
)
def gc_candidates_unfinished(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    unfinished = segments.where("state = 'Sealed' AND ext_id % 2 = 0").groupBy("ext_id").agg(F.max("seg").alias("seg"))
    return gc.candidates(segments, CONFIG.gc_ratio, SIZE, unsnapped=_unsnapped(segments), unfinished=unfinished)


@query(
    """SELECT c_custkey AS id, state = 'Sealed' AND job AND src AND coalesce(oids = 0, true) AS source_ready, state = 'Clone' AND job AND NOT src AND job_state <> 'Done' AS destination_ready, coalesce(old_total, c_custkey) AS published
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Sealed' WHEN 1 THEN 'Clone' ELSE 'ReadWrite' END AS state, c_custkey % 7 <> 0 AS job, c_custkey % 2 = 0 AS src,
  CASE c_custkey % 5 WHEN 0 THEN 9 WHEN 1 THEN NULL ELSE 0 END AS oids, CASE c_custkey % 4 WHEN 0 THEN 'Done' ELSE 'Doing' END AS job_state, CASE WHEN c_custkey % 11 = 0 THEN 1 END AS old_total FROM customer)"""
)
def clone_preconditions(spark, sf_dir):
    k = F.col("c_custkey")
    state = F.when(k % 3 == 0, "Sealed").when(k % 3 == 1, "Clone").otherwise("ReadWrite")
    oids = F.when(k % 5 == 0, 9).when(k % 5 == 1, None).otherwise(0)
    job = F.when(k % 7 != 0, F.struct((k % 2 == 0).alias("is_source"), F.when(k % 4 == 0, "Done").otherwise("Doing").alias("state"), oids.alias("oids_oid")))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), state.alias("s"), job.alias("job"), F.when(k % 11 == 0, 1).cast("long").alias("old_total"))
    no = F.lit(False)
    return rows.select("id", F.coalesce(clone.source_ready(F.col("s"), F.col("job")), no).alias("source_ready"), F.coalesce(clone.destination_ready(F.col("s"), F.col("job")), no).alias("destination_ready"), clone.publish(F.col("old_total"), F.col("id")).alias("published"))


@query(
    """SELECT * FROM (VALUES ('extent.segment_size', '1073741824'), ('extent.reserved_seg', '1'), ('extent.put_pending', '512'), ('extent.size_per_read', '4194304'), ('extent.max_dirty_count', '128'), ('extent.update_or_insert', 'False'),
  ('extent.gc_ratio', '0.55'), ('server.data_root', '/zai'), ('server.object_address', '0.0.0.0:8881'), ('server.operator_address', '0.0.0.0:8882'), ('perf.per_thread', '87381')) t(option, value)"""
)
def config_defaults(spark, sf_dir):
    extent, server, perf = ExtentConfig().adjusted(), ServerConfig(), PerfConfig()
    rows = [(f"extent.{x}", str(getattr(extent, x))) for x in ("segment_size", "reserved_seg", "put_pending", "size_per_read", "max_dirty_count", "update_or_insert", "gc_ratio")]
    rows += [(f"server.{x}", getattr(server, x)) for x in ("data_root", "object_address", "operator_address")] + [("perf.per_thread", str(perf.per_thread(perf.mb_per_put_thread)))]
    return spark.createDataFrame(rows, "option string, value string")


@query("SELECT o_orderkey AS word, (o_orderkey | (1::BIGINT << (o_orderkey % 60)::INT))::BIGINT AS with_bit, (o_orderkey & ~(1::BIGINT << (o_orderkey % 60)::INT))::BIGINT AS without, ((o_orderkey + 524287) // 524288)::BIGINT AS pieces FROM orders")
def bit_words(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("word"), s.set_bit(k, k % 60).alias("with_bit"), s.clear_bit(k, k % 60).alias("without"), s.oid_pieces(k).alias("pieces"))
