"""SimHash components against all pairs, and near dedup against shingle sets."""

import random
import re

import numpy as np
import pytest
import xxhash

from cairnframe.llm import op5_simhash as op


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """doc positions -> root by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts(rng, n):
    out = [None, "", "  ", "one", "One TWO", "one two", "É a b c", "É a b c"]
    for _ in range(n):
        words = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.choice([3, 4, 10, 80]))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words))
            out.append(" ".join([*words[:at], "zz", *words[at + 1 :]]))
    return [*out, "w " * 100_000]


@pytest.mark.parametrize("hot", [4096, 3])
def test_components_against_all_pairs(spark, hot, monkeypatch):
    rng = random.Random(hot)
    rows = [(i if i % 17 else None, t, "x") for i, t in enumerate(texts(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    monkeypatch.setattr(op.links, "__defaults__", (3, hot, None))
    got = op.classes(docs).collect()
    prints = [fingerprint(t) for _, t, _ in rows]
    root = components(prints)
    least = {}
    for (doc_id, _, _), r in zip(rows, root, strict=True):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    want = sorted(str((d, p, least.get(r))) for (d, _, _), p, r in zip(rows, prints, root, strict=True))
    assert sorted(str((x.doc_id, x.fp % 2**64, x.component_id)) for x in got) == want


def test_gray_index_finds_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]]))
    index = op.GrayIndex(fps)
    q, leaf = index.search(index.fps)
    pairs = {(int(a), int(b)) for a, b in zip(q, leaf, strict=True)}
    near = np.bitwise_count(index.fps[:, None] ^ index.fps[None, :]) <= 3
    assert pairs == {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)}
    assert np.all(np.diff(op.gray_rank(index.fps).astype(object)) > 0)


def test_empty(spark):
    assert op.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
