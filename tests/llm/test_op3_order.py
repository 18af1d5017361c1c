import hashlib

import numpy as np
import pytest

from cairnframe.llm import op3_order as op
from cairnframe.llm.tokens import END, encoding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_and_reverses(n):
    slots = op.permute(np.arange(n), n, "k")
    assert sorted(slots.tolist()) == list(range(n))
    assert (op.unpermute(slots, n, "k") == np.arange(n)).all()


def test_keys_give_other_orders():
    assert (op.permute(np.arange(1000), 1000, "a") != op.permute(np.arange(1000), 1000, "b")).mean() > 0.9


def _docs(spark):
    rows = [(i, "word %d again " % i * (i % 40)) for i in range(120)] + [(None, "no id"), (7, None), (8, ""), (9, "same"), (9, "same"), (10, "x" * 5000)]
    return rows, spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, slot string, part int")


def test_round_trip(spark, tmp_path):
    rows, docs = _docs(spark)
    out = op.records(docs, seq_len=16, shard_records=32, buckets=5)
    got = out.collect()
    n = len(got)
    assert sorted(r.slot for r in got) == list(range(n))
    assert all(r.shard == r.slot // 32 and r.byte_offset == r.slot % 32 * 32 and len(r.record) == 32 for r in got)
    enc = encoding()
    want = sorted((str(d), enc.encode_ordinary(t or "") + [END]) for d, t in rows)
    inverse = {int(s): i for i, s in enumerate(op.permute(np.arange(n), n))}
    back, last = [], None
    for r in sorted(got, key=lambda r: inverse[r.slot]):  # in the dense order the sequences of a document follow each other
        ids = np.frombuffer(r.record, "<u2")
        assert (ids[r.n_tokens :] == END).all()
        if r.seq_no == 0:
            last = []
            back.append((str(r.doc_id), last))
        last.extend(ids[: r.n_tokens].tolist())
    assert sorted(back) == want
    manifest = {r.shard: r for r in op.write_shards(out, f"file://{tmp_path}", 16).collect()}
    by_slot = {r.slot: r.record for r in got}
    for s, m in manifest.items():
        raw = (tmp_path / f"shard-{s:08d}.bin").read_bytes()
        assert raw == b"".join(bytes(by_slot[i]) for i in range(m.first_slot, m.first_slot + m.n_records))
        assert hashlib.sha256(raw).hexdigest() == m.sha256
    assert sum(m.n_records for m in manifest.values()) == n


def test_order_depends_on_rows_not_on_splits(spark):
    _, docs = _docs(spark)
    a = op.records(docs.repartition(3), 16, 32, buckets=4).select("slot", "doc_id", "record").collect()
    b = op.records(docs.repartition(7, "slot"), 16, 32, buckets=4).select("slot", "doc_id", "record").collect()
    assert sorted(a) == sorted(b) or {(r.slot, bytes(r.record)) for r in a} == {(r.slot, bytes(r.record)) for r in b}


def test_empty(spark):
    assert op.records(spark.createDataFrame([], "doc_id long, text string")).count() == 0
