import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnframe.llm import op8_counts as op
from cairnframe.llm.tokens import encoding

COUNTER = op.Counter()
CHARS = ["a", "B", "é", "1", "23", " ", "  ", "\n", "\t", "'s", "'", "!", "...", "word", " the", "😀", " "]


def check(text, edits):
    tree = op.tree_of(text, COUNTER)
    assert tree.total == len(encoding().encode_ordinary(text))
    new, anew = op.apply_edits(tree, text, edits, COUNTER)
    assert new == op.edited(text, sorted(edits))
    want = op.tree_of(new, COUNTER)
    assert [x for y, _ in tree.leaves for x in y] == [x for y, _ in want.leaves for x in y]
    assert tree.total == want.total == len(encoding().encode_ordinary(new))
    assert tree.sums[1] == (len(new), want.total)
    again = op.CountTree.load(tree.dump())
    assert again.total == tree.total and again.sums[1] == tree.sums[1]
    return anew


def random_edits(rng, n, k):
    cuts = sorted(rng.randrange(n + 1) for _ in range(2 * k))
    return [(cuts[2 * i], cuts[2 * i + 1], "".join(rng.choice(CHARS) for _ in range(rng.randrange(4)))) for i in range(k)]


@pytest.mark.parametrize("seed", range(400))
def test_random_edits(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(CHARS) for _ in range(rng.choice([0, 1, 3, 20, 200, 1500])))
    check(text, random_edits(rng, len(text), rng.choice([0, 1, 1, 2, 5])))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.integers(0, 2**32))
def test_any_text(text, seed):
    text = text.encode("utf-8", "ignore").decode()
    rng = random.Random(seed)
    tree = op.tree_of(text, COUNTER)
    edits = random_edits(rng, len(text), 2)
    new, _ = op.apply_edits(tree, text, edits, COUNTER)
    assert tree.total == op.tree_of(new, COUNTER).total


def test_only_touched_regions():
    text = "some words of a long text " * 4000
    assert check(text, [(50_000, 50_003, "xyz"), (10, 10, "in"), (90_000, 90_020, "")]) < 40
    assert check(text, [(0, 0, "word " * 5000)]) < 11_000


def test_overlap_is_an_error():
    with pytest.raises(ValueError):
        op.apply_edits(op.tree_of("abcdef", COUNTER), "abcdef", [(0, 3, ""), (2, 4, "")], COUNTER)


def test_frames(spark, tmp_path):
    texts = ["mail a.b@c.de or 12345 now", None, "", "plain", "1234" * 2000, "mail a.b@c.de or 12345 now"]
    spark.createDataFrame([(i % 5, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op.query(spark, str(tmp_path)).select("doc_id", "n_tokens", "n_edits", "n_tokens_after").collect())
    n = lambda t: len(encoding().encode_ordinary(t))
    after = ["mail [EMAIL] or [NUMBER] now", "", "", "plain", "[NUMBER]", "mail [EMAIL] or [NUMBER] now"]
    assert got == sorted((i % 5, n(t or ""), (2, 0, 0, 0, 1, 2)[i], n(after[i])) for i, t in enumerate(texts))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    states = op.build(docs.where("doc_id = 3"))
    rows = docs.where("doc_id = 3").join(states.select("doc_id", "state"), "doc_id").selectExpr("doc_id", "text", "state", "array(named_struct('start', 0, 'end', 2, 'new', 'sl')) edits")
    r = op.update(rows).first()
    assert (r.text, r.n_tokens) == ("slain", n("slain"))
