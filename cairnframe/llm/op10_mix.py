"""Mixing sources to target weights.

Method: token counts per source, water-filled targets, repetition rate = target / size, then every document is taken
``floor(rate)`` times plus one hash-seeded Bernoulli copy whose probability is the rate's fraction.  DataFrame functions only.

The documents are aggregated once (partial sums before the shuffle, so a hot source costs one row per task) and read once
more; the only join is with the table of sources, broadcast after its rows were counted.  Ranking and water-filling look at
one row per source.

Defined cases:

* null or empty text: size 0, never taken more than 0 words; its copies follow the rate of its source all the same.
* null source: a source of its own, the last.
* the draw comes from doc_id and text, so rows that share one of them are drawn apart; null doc_ids count as one more id.
* repeated rows: each counts; rows equal in doc_id and text share a draw.
* a source of size 0: target 0, rate 0.  Empty table: no rows.
* extra columns, also ones named like this module's own, go through :func:`mix` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, join_small

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only the document and the seed decide: the first 52 bits of an MD5."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")
    return bits.cast("double") / F.lit(float(2**52))


def plan_sources(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From rows (source, size) one row per source: source, source_size, target, rate.

    Sources in code-point order (null last) weigh ``weights``, repeating.  Targets share the total by weight, stop at
    ``max_repeat`` times the source's size, and the excess is shared anew by weight among the others.  The fixed point is
    min(cap, level * weight): in the order of cap / weight, the level is the first at which no later source is above its cap.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("long")
    per = per.select("source", "source_size", weight.alias("w"), rank.alias("r")).withColumn("cap", F.col("source_size") * max_repeat)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap").cast("double") / F.col("w"), "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = (
        per.withColumn("left", F.sum("source_size").over(everything) - (F.sum("cap").over(order) - F.col("cap")))
        .withColumn("w_left", F.sum("w").over(everything) - (F.sum("w").over(order) - F.col("w")))
        .withColumn("n", F.row_number().over(Window.orderBy(F.col("cap").cast("double") / F.col("w"), "r")))
        .withColumn("below", F.col("left").cast("double") / F.col("w_left") <= F.col("cap").cast("double") / F.col("w"))
    )
    per = per.withColumn("first", F.min(F.when(F.col("below"), F.struct("n", "left", "w_left"))).over(everything))
    share = (F.col("w") * F.col("first.left")).cast("double") / F.col("first.w_left")
    target = F.when(F.col("n") < F.col("first.n"), F.col("cap").cast("double")).otherwise(share)
    return per.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def _planned(docs: DataFrame, weights: Sequence[int], max_repeat: int, seed: str) -> DataFrame:
    """(row: the whole input row, size, source_size, target, copies)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count(F.col("text")).alias("size"))
    plan = plan_sources(docs.select(F.col("source").alias("source"), word_count(F.col("text")).alias("size")), weights, max_repeat).withColumnRenamed("source", "plan_source")
    out = join_small(rows, plan, F.col("row.source").eqNullSafe(F.col("plan_source")))
    whole = F.floor("rate")
    extra = (draw(F.col("row.doc_id"), F.col("row.text"), seed) < F.col("rate") - whole).cast("long")
    return out.select("row", "size", "source_size", "target", (whole + extra).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the input's columns, every document as often as it is taken."""
    out = _planned(docs, weights, max_repeat, seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies."""
    out = _planned(docs.select("doc_id", "text", "source"), weights, max_repeat, seed)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(documents(spark, sf_dir)).drop("copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r FROM d GROUP BY source
), c AS (
  SELECT *, (1 + r % 3)::BIGINT AS w, 3 * source_size AS cap FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, r) AS n,
    (sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap::DOUBLE / w, r ROWS UNBOUNDED PRECEDING) - cap))::BIGINT AS lft,
    (sum(w) OVER () - (sum(w) OVER (ORDER BY cap::DOUBLE / w, r ROWS UNBOUNDED PRECEDING) - w))::BIGINT AS w_left
  FROM c
), f AS (
  SELECT n AS fn, lft AS fl, w_left AS fw FROM o WHERE lft::DOUBLE / w_left <= cap::DOUBLE / w ORDER BY n LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN n < fn THEN cap::DOUBLE ELSE (w * fl)::DOUBLE / fw END AS target FROM o, f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t
)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (d.size * (floor(p.rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
      < p.rate - floor(p.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
