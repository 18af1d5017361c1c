"""``python -m cairnframe.cli -c FILE serve|perf``: run a catalogue's loops, or measure puts and gets against one."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as c
from .engine import Engine
from .operators import metrics
from .streaming.loops import Service


def filled(spark: SparkSession, n: int, block_kb: int, n_extents: int, seed: int = 1) -> DataFrame:
    """``n`` objects of ``block_kb`` KB: ext_id, seq, payload; no two are alike."""
    word = F.sha2(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary"), 256)
    payload = F.substring(F.repeat(word, block_kb * 16), 1, block_kb * 1024).cast("binary")
    return spark.range(n).select((F.col("id") % n_extents).alias("ext_id"), F.col("id").alias("seq"), payload.alias("payload"))


def perf(engine: Engine, perf_config: c.PerfConfig, objects: int, batches: int = 4) -> list[dict]:
    """Puts, gets or both by ``job_type`` (``put``, ``read``, ``rw``), in batches; ops, seconds and rate of each."""
    spark, n = engine.spark, max(1, perf_config.extents_per_disk)
    engine.create_extents(spark.range(n).select(F.col("id").alias("ext_id"), F.lit(1).alias("version"), F.lit("d").alias("disk_id")))
    out = []
    rows = filled(spark, objects, perf_config.block_size_kb, n)
    for kind in {"put": ["put"], "read": ["preload", "get"], "rw": ["put", "get"]}[perf_config.job_type]:
        for i in range(1 if kind == "preload" else batches):
            some = rows if kind == "preload" else rows.where(F.col("seq") % batches == i)
            began = time.perf_counter()
            if kind == "get":
                asked = engine.index.join(some.select("ext_id", "seq"), ["ext_id", "seq"], "left_semi").select("ext_id", "digest", *[F.lit(0).cast("long").alias(x) for x in ("offset", "n")])
                n_ok = engine.get(asked).where("err IS NULL AND piece IS NOT NULL").count()
            else:
                n_ok = engine.put(some).where("err IS NULL").count()
            out.append({"op": kind, "batch": i, "ok": n_ok, "seconds": time.perf_counter() - began})
    return [x | {"rate": round(x["ok"] / x["seconds"], 1)} for x in out if x["op"] != "preload"]


def report(spark: SparkSession, rows: list[dict]) -> str:
    samples = spark.createDataFrame([(x["op"], 1, int(x["seconds"] * 1e9), x["ok"] > 0) for x in rows], "op string, t_ns long, latency_ns long, ok boolean")
    seconds = sum(x["seconds"] for x in rows)
    return "\n".join(json.dumps(r.asDict()) for r in metrics.summary(samples, 0, F.lit(int(seconds * 1e9))).orderBy("op").collect())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairnframe", description=__doc__)
    parser.add_argument("-c", "--config", help="a TOML file with sections server, extent, perf")
    parser.add_argument("what", choices=["serve", "perf", "metrics"])
    parser.add_argument("--root", help="the catalogue's folder (default: data_root of the server)")
    parser.add_argument("--objects", type=int, default=1000)
    parser.add_argument("--ticks", type=int, help="serve: end after so many")
    args = parser.parse_args(argv)
    server, extent, perf_config = c.load(args.config) if args.config else (c.ServerConfig(), c.ExtentConfig().adjusted(), c.PerfConfig())
    spark = SparkSession.builder.appName("cairnframe").getOrCreate()
    engine = Engine(spark, args.root or server.data_root, extent)
    service = Service(engine, server)
    if args.what == "metrics":
        print(service.scrape(), end="")
    elif args.what == "perf":
        rows = perf(engine, perf_config, args.objects)
        print("\n".join(map(json.dumps, rows)))
        print(report(spark, rows))
    elif args.ticks is None:
        service.run()
    else:
        for _ in range(args.ticks):
            service.tick()
        service.close()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
