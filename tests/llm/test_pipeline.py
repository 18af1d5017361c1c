"""The pipeline stage by stage, each against what it should have done to its own input."""

import numpy as np
import pytest

import corpus_pipeline
from cairnframe.llm import op1_quality, op3_order, op7_decontaminate, op10_mix
from cairnframe.llm.tokens import END, encoding

from .test_op7_decontaminate import beyond_a_sample

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "t")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages_keep_the_columns(run):
    assert all(x.columns == run[0].columns for x in run[:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "source mix", "training order"]


def test_quality_stage(spark, run):
    kept = {x.doc_id for x in op1_quality.judge(run[0], spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {x.doc_id for x in run[1].collect()} == kept and kept


def test_near_duplicate_stage(run):
    before, after = run[1].collect(), {x.doc_id for x in run[2].collect()}
    sets = {x.doc_id: shingles(x.text) for x in before}
    ids = sorted(sets)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert not [p for p in near if p[0] in after and p[1] in after]
    related = {x for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.3 * max(1, len(sets[a] | sets[b])) for x in (a, b)}
    assert after >= {i for i in ids if i not in related}  # what is like nothing else stays


def test_decontamination_stage(spark, run):
    items = [op7_decontaminate.words_of(x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    after = {x.doc_id for x in run[3].collect()}
    for x in run[2].collect():
        words = b" ".join(op7_decontaminate.words_of(x.text))
        holds = any(b" ".join(i) in words for i in items if len(i) >= 6)
        pieces = {tuple(words.split()[k : k + 5]) for k in range(len(words.split()) - 4)}
        apart = all(not pieces & {tuple(i[k : k + 5]) for k in range(len(i) - 4)} for i in items)
        assert not (holds and x.doc_id in after)
        assert x.doc_id in after or not apart


def test_mix_stage(run):
    plan = {x.doc_id: x.copies for x in op10_mix.mix_plan(run[3]).collect()}
    assert {x.doc_id: x["count"] for x in run[4].groupBy("doc_id").count().collect()} == {k: v for k, v in plan.items() if v}


def test_training_order_stage(run):
    rows = run[5].collect()
    assert sorted(x.slot for x in rows) == list(range(len(rows)))
    enc, texts, copies = encoding(), {x.doc_id: x.text for x in run[4].collect()}, {}
    for x in run[4].groupBy("doc_id").count().collect():
        copies[x.doc_id] = x["count"]
    tokens = {}
    for x in rows:
        assert x.byte_offset == x.slot % op3_order.SHARD_RECORDS * 2 * op3_order.SEQ_LEN and x.shard == x.slot // op3_order.SHARD_RECORDS
        tokens.setdefault((x.doc_id, x.seq_no), []).append(np.frombuffer(bytes(x.record), "<u2")[: x.n_tokens].tolist())
    for d, text in texts.items():
        want = [*enc.encode_ordinary(text or ""), END]
        got = [t for k in range(-(-len(want) // op3_order.SEQ_LEN)) for t in tokens[d, k][0]]
        assert got == want and all(len(tokens[d, k]) == copies[d] for k in range(-(-len(want) // op3_order.SEQ_LEN)))


def test_run(spark, run):
    assert corpus_pipeline.run(spark, SF).count() == run[5].count()


def test_decontamination_stage_fits_on_all_texts(spark, tmp_path):
    docs, items, leaks = beyond_a_sample(spark)
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {x.doc_id for x in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()}
    assert len([i for i, _ in leaks if i not in kept]) >= 0.9 * len(leaks)
