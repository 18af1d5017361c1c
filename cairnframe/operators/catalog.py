"""Keyed operations on the index: put, get, delete, re-address, upsert.

Tables are keyed by (ext_id, digest).  Only narrow rows are shuffled: payloads stay in the log and are joined by address where
they are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALIGN, ExtentConfig
from ..functions import scalars as s
from .guards import first_error
from .placement import place

KEY = ["ext_id", "digest"]


def first_puts(puts: DataFrame) -> DataFrame:
    """The first row of each key.  A partial aggregation: copies of one digest are a row per task before the shuffle."""
    rest = [c for c in puts.columns if c not in KEY]
    best = puts.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "seq").alias("r"))
    return best.select(*KEY, "r.*").select(*puts.columns)


def put(puts: DataFrame, config: ExtentConfig, index: DataFrame | None = None, dirty: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """Every put with its place, or the error that refuses it: ext_id, seq, digest, grains, otype, seg, cur, history_idx, addr, err.

    In order: over a segment, deleted since the last snapshot (``dirty``), in the ``index``, put before in this batch, placement.
    With ``update_or_insert`` keys of the index are put again.  Extents and keys are checked exactly, so unlike a Bloom filter the
    dirty set never refuses a key that is not in it.
    """
    narrow = puts.select("ext_id", "seq", "digest", "grains", "otype")
    first = narrow.where(s.moved_bytes("grains") <= config.segment_size).groupBy(*KEY).agg(F.min("seq").alias("first_seq"))
    known = first
    for table, mark in ((dirty, "was_deleted"), (index if not config.update_or_insert else None, "in_index")):
        known = known.join(table.select(*KEY).distinct().withColumn(mark, F.lit(True)), KEY, "left") if table is not None else known.withColumn(mark, F.lit(None).cast("boolean"))
    judged = narrow.join(known, KEY, "left").withColumn(
        "err",
        first_error(
            (F.col("first_seq").isNull() | (s.moved_bytes("grains") > config.segment_size), "ObjectTooLarge"),
            (F.col("was_deleted"), "ObjectDirtyDeleted"),
            (F.col("in_index"), "ObjDigestExisted"),
            (F.col("seq") > F.col("first_seq"), "ObjDigestExisted"),
        ),
    ).drop("first_seq", "was_deleted", "in_index")
    placed = place(judged.where("err IS NULL").drop("err"), config, states)
    refused = judged.where("err IS NOT NULL")
    gone = [F.lit(None).cast("long").alias(c) for c in ("seg", "cur", "history_idx", "addr")]
    return placed.unionByName(refused.select("ext_id", "seq", "digest", F.col("grains").cast("long").alias("grains"), F.col("otype").cast("smallint").alias("otype"), *gone, "err"))


def accepted(results: DataFrame) -> DataFrame:
    return results.where("err IS NULL")


def lookup(requests: DataFrame, index: DataFrame) -> DataFrame:
    """``requests`` with found, offset and size of the object."""
    out = requests.join(index.select(*KEY, "addr", F.col("grains").alias("g")), KEY, "left")
    has = F.col("g").isNotNull() & (F.col("g") > 0)
    return out.select(*requests.columns, has.alias("found"), F.when(has, F.col("addr") * ALIGN).alias("offset"), F.when(has, F.col("g") * 4096).alias("size"))


def get_range(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """``requests`` (ext_id, digest, offset, n) with is_full, verified, piece, crc and err.

    n of 0 or of the whole size asks for all and is verified against the digest; other reads are pieces with a checksum of their own.
    A piece that leaves the object is refused.
    """
    out = requests.join(objects.select(*KEY, F.col("payload").cast("binary").alias("payload")), KEY, "left")
    size = F.octet_length("payload").cast("long")
    full = (F.col("n") == 0) | ((F.col("n") == size) & (F.col("offset") == 0))
    err = first_error((F.col("payload").isNull(), "NotFound"), (~full & ((F.col("offset") < 0) | (F.col("n") < 0) | (F.col("offset") + F.col("n") > size)), "OutOfRange"), (full & (s.digest("payload") != F.col("digest")), "ErrChecksum"))
    piece = F.when(F.col("err").isNull(), F.when(F.col("is_full"), F.col("payload")).otherwise(F.substring(F.col("payload"), (F.col("offset") + 1).cast("int"), F.col("n").cast("int"))))
    out = out.select(*requests.columns, "payload", full.alias("is_full"), err.alias("err"))
    return out.withColumn("piece", piece).withColumn("crc", s.checksum("piece")).drop("payload")


def delete(keys: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every requested key once, with found, addr and grains; the index without them)."""
    asked = keys.select(*KEY).distinct()
    found = asked.join(index.select(*KEY, "addr", "grains"), KEY, "left").select(*KEY, F.col("addr").isNotNull().alias("found"), "addr", "grains")
    return found, index.join(asked, KEY, "left_anti")


def explode_batches(log: DataFrame) -> DataFrame:
    """Rows ext_id, ts, kind, digest of a delete log whose rows hold arrays."""
    return log.select("ext_id", "ts", "kind", F.explode("digests").alias("digest"))


def throttle(deletes: DataFrame, cap: int) -> DataFrame:
    """Single deletes (ext_id, seq) beyond ``cap`` since the extent's log was last reset (column ``epoch``) are refused."""
    n = F.row_number().over(Window.partitionBy("ext_id", "epoch").orderBy("seq"))
    return deletes.withColumn("err", F.when(n > cap, F.lit("TooManyRequests")))


def readdress(index: DataFrame, moves: DataFrame) -> DataFrame:
    """The index with the last address of each key in ``moves`` (ext_id, digest, addr, seq); unknown keys are ignored."""
    last = moves.groupBy(*KEY).agg(F.max_by("addr", "seq").alias("new_addr"))
    return index.join(last, KEY, "left").withColumn("addr", F.coalesce("new_addr", "addr")).drop("new_addr")


def upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert keys that are not there; of those that are, only the address changes."""
    theirs = rows.select(*KEY, *[F.col(c).alias("new_" + c) for c in ("otype", "grains", "addr")])
    both = index.select(*KEY, "otype", "grains", "addr").join(theirs, KEY, "full_outer")
    return both.select(*KEY, F.coalesce("otype", "new_otype").alias("otype"), F.coalesce("grains", "new_grains").alias("grains"), F.coalesce("new_addr", "addr").alias("addr"))


def keep_newest(queue: DataFrame, limit: int) -> DataFrame:
    """A full queue drops its oldest requests (ext_id, seq): they fail with QueueOverflow."""
    n = F.row_number().over(Window.partitionBy("ext_id").orderBy(F.col("seq").desc()))
    return queue.withColumn("err", F.when(n > limit, F.lit("QueueOverflow")))


def shuffled(keys: DataFrame, seed: str) -> DataFrame:
    """Keys in a random order that the seed fixes, per extent: rn counts from 1."""
    h = F.md5(F.concat(F.lit(seed), F.col("digest").cast("string")).cast("binary"))
    return keys.withColumn("rn", F.row_number().over(Window.partitionBy("ext_id").orderBy(h, "digest")))


def synthetic_entries(spark, n: int) -> DataFrame:
    """``n`` index entries with distinct digests: multiplication by an odd number permutes the 32-bit words."""
    i = F.col("id")
    return spark.range(n).select(((i * 2654435761 + 12345) % (1 << 32)).alias("digest"), (i % 3 + 1).cast("smallint").alias("otype"), (i % 2046 + 1).alias("grains"), (i % (1 << 24)).alias("addr"))
