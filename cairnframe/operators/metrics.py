"""Throughput, latency and clock reports over samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import iops

#: the quantiles of a report, in percent
QUANTILES = (1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99, 99.5, 99.9, 99.95, 99.99)
#: Distinct latencies per op up to which exact quantiles are a small aggregation buffer.
EXACT_LIMIT = 2_000_000


def summary(samples: DataFrame, skip_ns: int, cost_ns) -> DataFrame:
    """Per op: ok, failed, iops, and min, mean, max latency of the samples after ``skip_ns``."""
    late = F.when(F.col("t_ns") > skip_ns, F.col("latency_ns"))
    out = samples.groupBy("op").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.min(late).alias("min_ns"), F.avg(late).alias("mean_ns"), F.max(late).alias("max_ns"))
    return out.withColumn("iops", iops(F.col("n_ok") + F.col("n_failed"), cost_ns))


def quantiles(samples: DataFrame, skip_ns: int, exact: bool | None = None, accuracy: int = 100_000) -> DataFrame:
    """Per op and quantile its latency: exact by interpolation, or within ``1 / accuracy`` of the rank.

    Exact quantiles keep a count of each distinct latency in one task an op.  Unless told, they are used where some sketch of the
    distinct latencies says that there are at most :data:`EXACT_LIMIT`.
    """
    if exact is None:
        most = samples.where(F.col("t_ns") > skip_ns).groupBy("op").agg(F.approx_count_distinct("latency_ns").alias("n")).agg(F.max("n")).first()[0]
        exact = (most or 0) <= EXACT_LIMIT
    shares = F.array(*[F.lit(q / 100) for q in QUANTILES])
    late = samples.where(F.col("t_ns") > skip_ns).groupBy("op")
    got = late.agg((F.percentile("latency_ns", shares) if exact else F.percentile_approx("latency_ns", shares, accuracy)).alias("q"))
    named = F.arrays_zip(F.array(*[F.lit(float(q)) for q in QUANTILES]).alias("pct"), F.col("q").alias("value"))
    return got.select("op", F.explode(named).alias("z")).select("op", F.col("z.pct").alias("pct"), F.col("z.value").cast("double").alias("value"))


def clock_jumps(readings: DataFrame) -> DataFrame:
    """Per clock how often its reading (ts, in order of seq) went back."""
    before = F.lag("ts").over(Window.partitionBy("clock").orderBy("seq"))
    return readings.withColumn("before", before).groupBy("clock").agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("before")).alias("n_jumps"))


def load_factor(runs: DataFrame) -> DataFrame:
    """Average, least and greatest load over capacities, and at which capacity: avg_load, min_load, min_cap, max_load, max_cap."""
    return runs.agg(
        F.avg("load").alias("avg_load"), F.min("load").alias("min_load"), F.min_by("cap", F.struct("load", "cap")).alias("min_cap"), F.max("load").alias("max_load"), F.max_by("cap", F.struct(F.col("load"), -F.col("cap"))).alias("max_cap")
    )


def exposition(values: DataFrame, name: str, labels: list[str], value: str, kind: str = "gauge") -> str:
    """The text that a metrics scrape reads: one line for each row of a small report (``labels`` tell its rows apart)."""
    escape = lambda x: str(x).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    lines = [f"# TYPE {name} {kind}"]
    for r in values.orderBy(*labels).toLocalIterator():
        inside = ",".join(f'{c}="{escape(r[c])}"' for c in labels)
        lines.append(f"{name}{{{inside}}} {r[value]}" if labels else f"{name} {r[value]}")
    return "\n".join(lines) + "\n"
