import random

import numpy as np

from cairnframe.llm import op7_decontaminate as op


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_bit_parallel_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 30))] for _ in range(2))
        item = op.Item(1, a)
        assert op.lcs_length(item.masks, item.full, b) == lcs(a, b)


def corpus():
    rng = random.Random(5)
    syllables = ["ka", "lo", "mi", "ren", "tu", "vas", "po", "shi", "dor", "el"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4)))

    common = [word() for _ in range(20)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]

    items = [prose(rng.randrange(15, 60)) for _ in range(30)] + [prose(200), prose(4)]
    docs, leaks = [], set()
    for i in range(200):
        words = prose(rng.randrange(30, 600))
        if i % 4 == 0:
            k = rng.randrange(len(items))
            leak = list(items[k])
            if i % 8 == 0 and len(leak) > 10:  # a paraphrase: a fifth of the words changed or dropped
                for j in rng.sample(range(len(leak)), len(leak) // 5):
                    leak[j] = word() if rng.random() < 0.6 else None
                leak = [w for w in leak if w]
            at = rng.randrange(len(words))
            words[at:at] = leak
            leaks.add((i, k))
        docs.append((i, " ".join(words)))
    return docs, list(enumerate(" ".join(x).capitalize() + "." for x in items)), leaks


def test_recall_and_precision_against_brute_force(spark):
    docs, items, leaks = corpus()
    rows = [(i, t, "x") for i, t in docs] + [(None, None, "x"), (1000, "", "x"), (1001, " ", "x"), (None, docs[4][1], "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    b = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = op.hits(d, b).collect()
    pairs = {(r.doc_id, r.item_id) for r in got if r.doc_id is not None}
    # brute force: every item at every place of every document
    want = set()
    for i, t in docs:
        words = op.words_of(t)
        for k, text in items:
            item = op.Item(k, op.words_of(text))
            if any(item.check(words, s) for s in range(0, max(1, len(words)), item.window // 4)):
                want.add((i, k))
    assert len(pairs & want) >= 0.9 * len(want) and pairs <= want
    assert leaks <= want and len(leaks & pairs) >= 0.95 * len(leaks)
    assert any(r.doc_id is None for r in got)
    kept = {r.doc_id for r in op.clean(d, b).collect()}
    assert kept - {None} == {i for i, _ in docs} - {i for i, _ in pairs} | {1000, 1001}
    assert op.clean(d, b).columns == d.columns


def test_blocks_of_items_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(op, "GROUP", 7)
    docs, items, leaks = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    pairs = {(r.doc_id, r.item_id) for r in op.hits(d, b).collect()}
    assert len(leaks & pairs) >= 0.95 * len(leaks)


def test_spans_of_long_texts(spark, monkeypatch):
    docs, items, leaks = corpus()
    searcher = next(op.models(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    whole = " ".join(t for _, t in docs)
    a = {x[0] for x in searcher.hits(whole)}
    monkeypatch.setattr(op, "SPAN", 1024)
    assert {x[0] for x in searcher.hits(whole)} == a >= {k for _, k in leaks}


def test_paraphrase_in_other_words_is_found_by_the_latent_space(spark):
    """Synonyms keep the same company in the corpus; the item's rare words are exchanged for words that the benchmark lacks."""
    rng = random.Random(8)
    frame = [f"fun{i}" for i in range(12)]
    topics = [([f"a{t}x{i}" for i in range(8)], [f"b{t}x{i}" for i in range(8)]) for t in range(25)]

    def passage(t, names, n=40):
        """Frame words, and among them the topic's words, of either name."""
        return [rng.choice(frame) if k % 2 else rng.choice(names or rng.choice(topics[t])) for k in range(n)]

    docs = [(i, " ".join(w for _ in range(8) for w in passage(i % 25, None))) for i in range(400)]
    items, leaks = [], []
    for t in range(25):
        words = passage(t, topics[t][0])
        other = dict(zip(*topics[t], strict=True))
        items.append((t, " ".join(words)))
        # the frame stays, and its order, and most of what the answer says
        leak = [other.get(w, w) if k < 34 else w for k, w in enumerate(words)]
        docs.append((1000 + t, " ".join([*passage((t + 7) % 25, topics[(t + 7) % 25][0], 14), *leak])))
        leaks.append((1000 + t, t))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in op.hits(d, b).collect()}
    plain = {(r.doc_id, r.item_id) for r in op.hits(d, b, latent=2.0).collect()}
    assert len(set(leaks) & found) >= 0.9 * len(leaks) and len(set(leaks) & plain) <= 0.7 * len(leaks)


def test_repeated_items_and_rows(spark):
    docs, items, leaks = corpus()
    d = spark.createDataFrame([docs[4], docs[4], docs[0]], "doc_id long, text string")
    b = spark.createDataFrame([*items, *items], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in op.hits(d, b).collect()]
    for i, k in leaks & {(i, k) for i in (0, 4) for k in range(len(items))}:
        assert got.count((i, k)) == 2 * (2 if i == 4 else 1)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([(1, "some words of an item that is long enough")], "item_id long, text string")
    assert op.hits(d, b).count() == 0 and op.hits(b.withColumnRenamed("item_id", "doc_id"), b.limit(0)).count() == 0
    assert op.hits(b.withColumnRenamed("item_id", "doc_id"), b).count() == 1


def beyond_a_sample(spark):
    """Texts on 25 topics behind, by their hashes, more than 2000 others that have none of the topics' words; items and their paraphrases."""
    rng = random.Random(8)
    frame = [f"fun{i}" for i in range(12)]
    topics = [([f"a{t}x{i}" for i in range(8)], [f"b{t}x{i}" for i in range(8)]) for t in range(25)]

    def passage(t, names, n=40):
        return [rng.choice(frame) if k % 2 else rng.choice(names or rng.choice(topics[t])) for k in range(n)]

    others = [(" ".join([*frame[:3], *(f"other{rng.randrange(200)}" for _ in range(4)), f"only{i}"]), True) for i in range(4400)]
    told = [(" ".join([*(w for _ in range(8) for w in passage(i % 25, None)), f"n{k}"]), False) for i in range(400) for k in range(2)]
    rows = spark.createDataFrame(others + told, "text string, other boolean").where("(xxhash64(text) < 0) = other").collect()
    docs = [(i, r.text) for i, r in enumerate(rows)]
    assert sum(r.other for r in rows) >= 2000 and sum(not r.other for r in rows) >= 300
    items, leaks = [], []
    for t in range(25):
        words = passage(t, topics[t][0])
        other = dict(zip(*topics[t], strict=True))
        items.append((t, " ".join(words)))
        leak = [other.get(w, w) if k < 34 else w for k, w in enumerate(words)]
        docs.append((100_000 + t, " ".join([*passage((t + 7) % 25, topics[(t + 7) % 25][0], 14), *leak])))
        leaks.append((100_000 + t, t))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), leaks


def test_latent_space_is_fitted_on_all_texts(spark):
    d, b, leaks = beyond_a_sample(spark)
    found = {(r.doc_id, r.item_id) for r in op.hits(d, b).collect()}
    assert len(set(leaks) & found) >= 0.9 * len(leaks)


def test_gram_of_all_passages_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 400, n).astype("<u2") for n in [*rng.integers(1, 700, 60), 1, 64, 65, 128, 9000]]
    idf = np.zeros(op.BUCKETS)
    idf[5:400] = rng.random(395)  # the first are too common
    base = rng.standard_normal((op.BUCKETS, 7))
    want = np.zeros(base.shape)
    for x in texts:
        for low in range(0, len(x), op.FIT_WINDOW):
            a = np.bincount(x[low : low + op.FIT_WINDOW], minlength=op.BUCKETS) * idf
            a /= max(np.linalg.norm(a), 1e-12)
            want += np.outer(a, a @ base)
    rows = spark.createDataFrame([(bytearray(x.tobytes()),) for x in texts], "ids binary").repartition(5)
    assert np.allclose(op._gram(rows, idf, base), want, rtol=1e-3, atol=1e-4)
