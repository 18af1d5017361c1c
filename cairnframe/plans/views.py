"""The test tables read as object-store tables, in Spark and in SQL.

``documents`` are objects (256 to an extent, so the number of extents follows the data), toxic labels are deletes, ``events`` an
operation log, ``customer`` and ``orders`` the two sides of a reconciliation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExtentConfig
from ..functions import scalars as s
from ..operators import catalog

PER_EXTENT = 256
CONFIG = ExtentConfig(segment_size=256 << 10, gc_ratio=0.05)
SIZE = CONFIG.segment_size
GRAINS = SIZE // 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    """ext_id, seq, digest, n_bytes, grains, otype of every document, and its payload if that is asked for."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents")
    own = [text.cast("binary").alias("payload")] if payload else []
    out = docs.select(s.div("doc_id", PER_EXTENT).alias("ext_id"), F.col("doc_id").alias("seq"), s.digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), *own)
    return out.withColumn("grains", s.grains_of("n_bytes")).withColumn("otype", F.lit(1).cast("smallint"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after all objects were put: first puts, placed."""
    rows = objects(spark, sf_dir).where(s.moved_bytes("grains") <= SIZE)
    from ..operators.placement import place

    return place(catalog.first_puts(rows.select("ext_id", "digest", "seq", "grains", "otype")), CONFIG).where("err IS NULL").drop("err")


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ext_id, digest, ts: the objects of toxic documents."""
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    return objects(spark, sf_dir).join(bad, F.col("seq") == F.col("doc_id"), "left_semi").select("ext_id", "digest", F.col("seq").alias("ts"))


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ext_id, digest, seq, op, new_addr, t_us, value from the events; the key is the user."""
    op = F.when(F.col("event_type") == "purchase", "put").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "readdress").otherwise("get")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("ext_id"), F.col("user_id").alias("digest"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").alias("new_addr"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "value"
    )


OBJ = """obj AS (
  SELECT doc_id // 256 AS ext_id, doc_id AS seq, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT AS digest, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    greatest(1, (strlen(coalesce(text, '')) + 4095) // 4096)::BIGINT AS grains, ((4096 + greatest(1, (strlen(coalesce(text, '')) + 4095) // 4096) * 4096 + 16383) // 16384 * 16384)::BIGINT AS mov,
    coalesce(text, '') AS payload
  FROM documents
)"""
WIN = f"""win AS (
  SELECT ext_id, digest, seq, grains, mov FROM obj WHERE mov <= {SIZE} QUALIFY row_number() OVER (PARTITION BY ext_id, digest ORDER BY seq) = 1
)"""
IDX = f"""steps AS (
  SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY seq) AS rn FROM win
), fold AS (
  SELECT ext_id, rn, seq, digest, grains, mov, 0::BIGINT AS seg, 0::BIGINT AS cur FROM steps WHERE rn = 1
  UNION ALL
  SELECT n.ext_id, n.rn, n.seq, n.digest, n.grains, n.mov, CASE WHEN p.cur + p.mov + n.mov > {SIZE} THEN p.seg + 1 ELSE p.seg END, CASE WHEN p.cur + p.mov + n.mov > {SIZE} THEN 0 ELSE p.cur + p.mov END
  FROM fold p JOIN steps n ON n.ext_id = p.ext_id AND n.rn = p.rn + 1
), idx AS (
  SELECT ext_id, seq, digest, grains, mov, seg, cur, seg AS history_idx, (seg * {SIZE} + cur) // 16384 AS addr FROM fold WHERE seg < 255
)"""
DEL = """del AS (
  SELECT DISTINCT ext_id, digest, seq AS ts FROM obj WHERE seq IN (SELECT doc_id FROM labels WHERE toxic = 1)
)"""
SEGS = """gone AS (
  SELECT ext_id, seg, sum(mov // 4096)::BIGINT AS removed FROM idx WHERE (ext_id, digest) IN (SELECT (ext_id, digest) FROM del) GROUP BY ALL
), used AS (
  SELECT ext_id, seg, max(seq) AS sealed_hours, max(history_idx) AS history_idx FROM idx GROUP BY ALL
), last AS (
  SELECT ext_id, max(history_idx) AS last_idx FROM used GROUP BY ALL
), segs AS (
  SELECT last.ext_id, r.seg, CASE WHEN used.history_idx = last_idx THEN 'Writable' WHEN used.history_idx IS NOT NULL THEN 'Sealed' WHEN r.seg >= 255 THEN 'Reserved' ELSE 'Ready' END AS state,
    sealed_hours, used.history_idx, last_idx, coalesce(removed, 0)::BIGINT AS removed
  FROM last CROSS JOIN (SELECT unnest(range(256)) AS seg) r LEFT JOIN used ON used.ext_id = last.ext_id AND used.seg = r.seg LEFT JOIN gone ON gone.ext_id = last.ext_id AND gone.seg = r.seg
)"""
CAND = f"""cand AS (
  SELECT ext_id, seg, removed, sealed_hours, row_number() OVER (PARTITION BY ext_id ORDER BY removed DESC, sealed_hours, seg) AS rank
  FROM segs WHERE state = 'Sealed' AND history_idx < last_idx - 1 AND removed >= {int(GRAINS * 0.05)}
)"""
OPS = """ops AS (
  SELECT user_id % 3 AS ext_id, user_id AS digest, event_id AS seq, event_id AS new_addr, epoch_us(ts) AS t_us, value,
    CASE event_type WHEN 'purchase' THEN 'put' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'readdress' ELSE 'get' END AS op
  FROM events
)"""


def sql(*parts: str) -> str:
    """A query over named parts: all but the last are common table expressions."""
    return "WITH RECURSIVE " + ", ".join(parts[:-1]) + "\n" + parts[-1]
