"""The loops of a server, its configuration file and its command line."""

import json

import pytest
from pyspark.sql import functions as F

from cairnframe import cli, config
from cairnframe.engine import Engine
from cairnframe.streaming.loops import Service


def made(spark, root, n=40, **options):
    engine = Engine(spark, f"file://{root}", config.ExtentConfig(segment_size=1 << 17, **options))
    engine.create_extents(spark.range(2).select(F.col("id").alias("ext_id"), F.lit(1).alias("version"), F.lit("d").alias("disk_id")))
    engine.put(cli.filled(spark, n, 12, 2))
    return engine


def test_loops_and_close(spark, tmp_path):
    now = [0.0]
    answers = []

    def ask(reported):
        answers.append(reported.collect())
        return spark.createDataFrame([(0, "ReadWrite", 1, 0, 1, False), (1, "ReadWrite", 1, 0, 1, False), (5, "ReadWrite", 0, 0, 1, False)], "ext_id long, state string, created int, group_id int, version int, new_source boolean")

    engine = made(spark, tmp_path / "a", gc_interval_s=100, deep_gc_interval_s=1000)
    service = Service(engine, config.ServerConfig(heartbeat_s=10, snapshot_s=20), ask=ask, clock=lambda: now[0])
    assert service.tick() == ["heartbeat", "snapshot", "clone"]
    assert answers[0][0].n_extents == 2 and {x.ext_id for x in engine.extents.collect()} == {0, 1, 5}
    assert service.tick() == []
    now[0] = 11
    assert service.tick() == ["heartbeat"]
    service.force("gc")
    now[0] = 12
    assert service.tick() == ["gc"]
    now[0] = 120
    assert set(service.tick()) == {"heartbeat", "snapshot", "clone", "gc"}
    text = service.scrape()
    assert 'objects{ext_id="0"} 20' in text and 'segments{ext_id="1",state="Writable"} 1' in text
    service.loops["clone"].action = lambda: 1 / 0
    service.force("clone")
    assert service.tick() == [] and service.loops["clone"].failures == 1
    engine.delete(engine.index.select("ext_id", "digest").limit(3), batch=True)
    service.close()
    assert engine._table("deletes").count() == 0
    with pytest.raises(RuntimeError):
        service.tick()


def test_snapshot_policy(spark, tmp_path):
    engine = made(spark, tmp_path / "a", max_dirty_count=5)
    assert engine.maybe_snapshot()  # the first always is
    assert not engine.maybe_snapshot()  # young, and nothing was deleted
    engine.delete(engine.index.select("ext_id", "digest").limit(5), batch=True)
    assert engine.maybe_snapshot() and engine._table("deletes").count() == 0
    assert engine.maybe_snapshot(force=True)


def test_clone_is_polled_until_it_is_done(spark, tmp_path):
    source, target = made(spark, tmp_path / "a"), made(spark, tmp_path / "b", n=10)
    service = Service(target, clone_source=lambda: source)
    assert service.poll_clone() is not None and service.poll_clone() is None
    assert target.index.count() == 40


def test_configuration_file(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[server]\ndata_root = "/x"\n[extent]\nsegment_size = 1048576\ngc_ratio = 0.3\n[perf]\njob_type = "put"\n')
    server, extent, perf = config.load(path)
    assert (server.data_root, server.group_id, extent.segment_size, extent.gc_ratio, extent.max_dirty_count, perf.job_type) == ("/x", 1, 1 << 20, 0.3, 1, "put")
    for text in ("[server]\nroot = 1\n", "[sever]\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            config.load(path)


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "c.toml"
    path.write_text(f'[server]\ndata_root = "file://{tmp_path}/d"\n[extent]\nsegment_size = 1048576\n[perf]\njob_type = "rw"\nextents_per_disk = 2\n')
    assert cli.main(["-c", str(path), "perf", "--objects", "60"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert sum(x["ok"] for x in rows if x.get("op") == "put" and "ok" in x) == 60 == sum(x["ok"] for x in rows if x.get("op") == "get" and "ok" in x)
    assert cli.main(["-c", str(path), "serve", "--ticks", "1"]) == 0
    assert cli.main(["-c", str(path), "metrics"]) == 0
    assert 'objects{ext_id="1"} 30' in capsys.readouterr().out
