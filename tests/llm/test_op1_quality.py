"""Quality rules: the numbers and the certified cutoffs against plain Python."""

import math
import random
import re

from pyspark.sql import functions as F

from cairnframe.llm import op1_quality as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def numbers(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + o for i, g in enumerate(grams) if g in twice for o in range(3)}),
    }


def corpus(spark, n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "one", "two", "tree", "sky", "🙂é", "#tag"]) + str(rng.randrange(99)) for _ in range(rng.randrange(60, 120))]
        if not good:
            words = [w.upper() + "!!" if rng.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words) + ("\nsame\nsame" * (i % 4)), "en" if i % 2 else None, "extra"))
        labels.append((i, int(good)))
    rows += [(9001, None, "en", ""), (9002, "", None, ""), (9003, "a b c " * 100, "en", ""), (None, "word " * 5, None, ""), (9005, "x\ny\nx\n\n x y z x y z", "fr", ""), (9005, "x\ny\nx\n\n x y z x y z", "fr", ""), (9006, "w" * 200_000 + " b c d", "en", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, x string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")


def test_numbers_and_base(spark):
    docs, labels = corpus(spark)
    texts = docs.select("doc_id", "text").collect()
    got = op.judge(docs, labels).collect()
    want = sorted(str((t.doc_id, sorted(numbers(t.text).items()))) for t in texts)
    assert sorted(str((g.doc_id, sorted((k, g[k]) for k in op.NUMBERS[:5]))) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.base_failed and g.kept)


def test_bad_rows_go_and_good_ones_stay(spark):
    docs, labels = corpus(spark, 1500)
    kept = {g.doc_id for g in op.judge(docs, labels).where("kept").collect()}
    good = [i for i in range(1500) if i % 3 > 0]
    assert sum(i not in kept for i in good) <= op.ALPHA * len(good)
    assert sum(i in kept for i in range(1500) if i % 3 == 0) < 50
    out = op.filter_documents(docs, labels)
    assert out.columns == docs.columns and {x.doc_id for x in out.collect()} == kept


def test_nothing_is_certified_without_evidence(spark):
    docs, labels = corpus(spark, 60)
    got = op.judge(docs, labels).collect()
    assert all(g.kept != g.base_failed for g in got)
    empty = op.judge(docs, labels.limit(0)).collect()
    assert all(g.kept != g.base_failed for g in empty)
    assert op.judge(docs.limit(0), labels).count() == 0


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 10, 150, 4000) for k in (0, 1, 3, 20, 70) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", op.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for x in got:
        exact = sum(math.comb(x.n, j) * 0.02**j * 0.98 ** (x.n - j) for j in range(x.k + 1))
        assert x.p == 1.0 if x.k > 0.02 * x.n else abs(x.p - exact) < 1e-9 * max(1, exact)
