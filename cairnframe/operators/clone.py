"""Cloning: export of an extent's key set in pieces, and the plan of what a destination copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLONE, EXT_SEALED, OIDS_PER_PIECE

KEY = ["ext_id", "digest"]


def source_ready(state: Column, job: Column) -> Column:
    """Whether a sealed extent has a source job whose list is not out yet."""
    return (state == EXT_SEALED) & job.isNotNull() & job["is_source"] & F.coalesce(job["oids_oid"] == 0, F.lit(True))


def destination_ready(state: Column, job: Column) -> Column:
    return (state == CLONE) & job.isNotNull() & ~job["is_source"] & (job["state"] != "Done")


def export_chunks(index: DataFrame, per_piece: int = OIDS_PER_PIECE) -> DataFrame:
    """ext_id, piece, n, first_digest, last_digest, n_bytes of each extent's list of ids, in order of the digest.

    Keys of all tables count once.
    """
    keys = index.select(*KEY).distinct()
    at = F.row_number().over(Window.partitionBy("ext_id").orderBy("digest")) - 1
    chunks = keys.withColumn("piece", F.floor(at / per_piece).cast("long")).groupBy("ext_id", "piece")
    return chunks.agg(F.count("*").alias("n"), F.min("digest").alias("first_digest"), F.max("digest").alias("last_digest")).withColumn("n_bytes", F.col("n") * 8)


def export_pieces(index: DataFrame, per_piece: int = OIDS_PER_PIECE) -> DataFrame:
    """ext_id, piece, digests: the lists themselves, at most ``per_piece`` ids each, in order."""
    keys = index.select(*KEY).distinct()
    at = F.row_number().over(Window.partitionBy("ext_id").orderBy("digest")) - 1
    return keys.withColumn("piece", F.floor(at / per_piece).cast("long")).groupBy("ext_id", "piece").agg(F.array_sort(F.collect_list("digest")).alias("digests"))


def export_summary(extents: DataFrame, index: DataFrame, per_piece: int = OIDS_PER_PIECE) -> DataFrame:
    """ext_id, total, kind: Nop for an empty extent, Normal for one piece, Link for more."""
    n = index.select(*KEY).distinct().groupBy("ext_id").agg(F.count("*").alias("total"))
    out = extents.select("ext_id").join(n, "ext_id", "left").select("ext_id", F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    return out.withColumn("kind", F.when(F.col("total") == 0, "Nop").when(F.col("total") <= per_piece, "Normal").otherwise("Link"))


def publish(job_total: Column, total: Column) -> Column:
    """The first total that is published stays."""
    return F.coalesce(job_total, total)


def missing(source: DataFrame, local: DataFrame) -> DataFrame:
    """Keys that the destination has to copy."""
    return source.join(local.select(*KEY), KEY, "left_anti")


def copy_plan(source: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Every key of the source with what to do: present, copy, or absent (no replica has it any more)."""
    have = local.select(*KEY).distinct().withColumn("here", F.lit(True))
    there = remote.select(*KEY).distinct().withColumn("there", F.lit(True))
    out = source.select(*KEY).distinct().join(have, KEY, "left").join(there, KEY, "left")
    return out.select(*KEY, F.when(F.col("here"), "present").when(F.col("there"), "copy").otherwise("absent").alias("action"))


def progress(plan: DataFrame) -> DataFrame:
    """ext_id, total, done, missing, state of each clone."""
    out = plan.groupBy("ext_id").agg(F.count("*").alias("total"), F.count_if(F.col("action") != "absent").alias("done"), F.count_if(F.col("action") == "absent").alias("missing"))
    return out.withColumn("state", F.when(F.col("done") + F.col("missing") == F.col("total"), "Done").otherwise("Doing"))
