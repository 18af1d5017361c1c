import random
import zlib

import numpy as np

from cairnframe.llm import op6_fm as op


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = np.array(labels) > 0
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    m = op.Model(0.3, rng.normal(size=50).astype("f4"), rng.normal(size=(50, 4)).astype("f4"))
    i, x = np.array([3, 7, 20, 49]), np.array([0.5, -1, 2, 0.1], dtype="f4")
    pairs = sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(4) for b in range(a + 1, 4))
    want = 1 / (1 + np.exp(-(0.3 + m.w[i] @ x + pairs)))
    assert abs(m.score(i, x) - want) < 1e-5


def test_held_out_accuracy(spark, tmp_path):
    rng = random.Random(2)
    words = ["and", "the", "of", "river", "stone", "open", "field"]
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["!!", "###", "$"])) for _ in range(60))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    docs += [(None, None, None, None, None), (1000, "", "en", "s", 0), (5, docs[5][1], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert auc([r.score for r in held], [labels[r.doc_id][1] for r in held]) > 0.99
    again = {(r.doc_id, r.score) for r in op.query(spark, str(tmp_path)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (2, None, None)], "doc_id long, text string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = op.train(docs, none)
    assert [r.score for r in op.score(docs, model).collect()] == [0.5, 0.5]
    assert op.score(docs.limit(0), model).count() == 0
