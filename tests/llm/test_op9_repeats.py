import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from cairnframe.llm import op9_repeats as op


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        runs = op.merged((i, i + length) for i in range(len(r) - length + 1) if seen[r[i : i + length]] > 1)
        ends = [0, *(x for run in runs for x in run), len(r)]
        kept = b"".join(r[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2))
        out.append((len(r) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, length):
    """Words covered by runs of ``length`` words that also start elsewhere."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    return [len({i + k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(length)}) for w in split]


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gam", "d", "epsilon", "zetaß", "eta", "theta"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))

    texts = [prose(rng.randrange(5, 120)) for _ in range(40)]
    passage = prose(25)
    for i in range(0, 30, 3):
        at = rng.randrange(len(texts[i]))
        texts[i] = texts[i][:at] + passage[rng.randrange(10) : len(passage) - rng.randrange(10)] + texts[i][at:]
    for i in range(10):  # near copies: edits at many distances
        t = list(texts[i])
        for _ in range(rng.randrange(1, 6)):
            t[rng.randrange(len(t))] = rng.choice("xyzß")
        texts.append("".join(t))
    texts += [texts[3], texts[3], None, "", "short", "short", "a" * 300, "ab" * 100, texts[5] + texts[5], "é" * 90]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    texts, length = corpus(seed), 40
    docs = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, key binary")
    got = op.removed(docs, length).collect()
    by_key = {bytes(r.key): (r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    for t, want in zip(texts, brute(texts, length)):
        raw = (t or "").encode()
        assert by_key.get(hashlib.md5(raw).digest(), (0, 0, hashlib.sha256(raw).hexdigest())) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, seed):
    texts, length = corpus(seed), 9
    texts += [t.replace(" ", "\n \t") for t in texts if t][:8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {bytes(r.key): r.n for r in op.passages(docs, length).collect()}
    want = brute_words(texts, length)
    assert [got.get(hashlib.md5((t or "").encode()).digest(), 0) for t in texts] == want and sum(want) > 500


def test_query_and_repeated_rows(spark, tmp_path):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [long, long[500:1200], long[:399], "x" + long[:400], None, "", long]
    spark.createDataFrame([(i % 5, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in op.query(spark, str(tmp_path)).collect())
    want = sorted((i % 5, len((t or "").encode()), *w, n) for i, (t, w, n) in enumerate(zip(texts, brute(texts, 400), brute_words(texts, 51), strict=True)))
    assert got == want


def test_segments_of_long_texts(monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 64)
    rng = random.Random(4)
    raw = np.frombuffer("".join(rng.choice("abc") for _ in range(1000)).encode(), dtype=np.uint8)
    p, a, b, q, e = op.anchors(raw, 40)
    covered = [s for x, y in zip(a, b) for s in range(x, y + 1)]
    assert covered == list(range(1000 - 40 + 1))  # every window once
    assert all(x + 30 >= 0 and y <= x_ and x_ + 10 <= z + 40 for x, y, x_, z in zip(a, b, p, a))
    start = np.array([0, 100, 700, 50]), np.array([200, 300, 990, 400])
    assert (op.hash_spans(raw, *start, 0) == [op.Hasher(raw[x:y]).of(0, np.array([0]), np.array([y - x]))[0] for x, y in zip(*start)]).all()


def test_dedup_keeps_columns(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    docs = spark.createDataFrame([(1, long, "row"), (2, "tail " + long[100:700], None), (3, None, "z")], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in op.dedup(docs).collect()}
    assert got[1].text == long[:100] + long[700:] and got[2].text == "tail " and got[3].text is None and got[1].kept == "row"


def test_empty(spark):
    assert op.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
