"""Source mixing against the water-filling rules in plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from cairnframe.llm import op10_mix as op


def targets(sizes):
    """Share out round by round until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def corpus(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 40))), rng.choice(["b", "b", "b", "a", "é", "Z", "", None, "tiny" if i < 30 else "b"]), i) for i in range(2000)]
    rows += [(3000, None, "nothing", 0), (None, "a b", "a", 0), (None, "c d", "a", 0), (7, "x y z", "a", 0), (7, "x y z", "a", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets_and_copies(spark):
    rows, docs = corpus(spark)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    got = op.mix_plan(docs).collect()
    plan = {x.source: x for x in op.plan_sources(docs.select("source", op.word_count(F.col("text")).alias("size"))).collect()}
    assert all(abs(plan[s].target - want[s]) < 1e-6 * max(1, want[s]) and plan[s].source_size == sizes[s] for s in sizes)
    assert all(0 <= x.taken <= 3 * x.size for x in got) and len(got) == len(rows)
    rate = {s: want[s] / sizes[s] if sizes[s] else 0 for s in sizes}
    taken = dict.fromkeys(sizes, 0)
    by = {x.doc_id: x for x in got}
    for d, t, s, _ in rows:
        if d is None:
            continue
        u = int(hashlib.md5(f"mix-1:{d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        if d != 7:
            assert by[d].taken == n * (int(rate[s]) + (u < rate[s] - int(rate[s])))
        taken[s] += by[d].taken if d != 7 else 0
    assert abs(taken["b"] - want["b"]) < 0.1 * want["b"]


def test_mix_emits_the_copies(spark):
    _, docs = corpus(spark)
    out = op.mix(docs)
    assert out.columns == docs.columns
    n = {x.doc_id: x.copies for x in op.mix_plan(docs).where("doc_id <> 7").collect()}
    counted = {x.doc_id: x["count"] for x in out.where("doc_id <> 7").groupBy("doc_id").count().collect()}
    assert counted == {k: v for k, v in n.items() if v}
    assert sorted(map(str, op.mix(docs).collect())) == sorted(map(str, op.mix(docs.repartition(5)).collect()))


def test_empty(spark):
    _, docs = corpus(spark)
    assert op.mix(docs.limit(0)).count() == 0 and op.mix_plan(docs.limit(0)).count() == 0
    one = op.mix_plan(docs.where("source = 'nothing'")).collect()
    assert [(x.size, x.target, x.taken) for x in one] == [(0, 0.0, 0)]
