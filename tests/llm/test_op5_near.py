import random

from cairnframe.llm import op5_near as op


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / max(1, len(x | y))


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    groups = [[" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(120, 400)))] for _ in range(60)]
    for g in groups[:40]:
        for _ in range(4):
            words = g[0].split()
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            g.append(" ".join(words))
    rows = [(len(groups) * k + i, t, "c") for i, g in enumerate(groups) for k, t in enumerate(g)]
    rows += [(5000, None, "c"), (5001, None, "c"), (5002, "", "c"), (None, groups[0][0], "c"), (None, "quite another text of no group " + " ".join(vocabulary[:100]), "c"), (7, rows[7][1], "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, wide string")
    got = op.near_dedup(docs)
    assert got.columns == docs.columns
    left = got.collect()
    for i, g in enumerate(groups):
        mine = [x for x in left if x.doc_id is not None and x.doc_id < 5000 and x.doc_id % len(groups) == i]
        linked = [t for t in g if jaccard(g[0], t) >= 0.8]
        assert [x.doc_id for x in mine if x.text in linked] == [i]
    assert len([x for x in left if not x.text]) == 1 and len([x for x in left if x.doc_id is None]) == 1
    assert op.near_dedup(docs.limit(0)).count() == 0


def made_texts(rng, n):
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    return [[rng.choice(vocabulary) for _ in range(rng.randrange(80, 400))] for _ in range(n)]


def test_near_dedup_links_appended_and_exchanged_passages(spark):
    rng = random.Random(11)
    groups, other = made_texts(rng, 120), made_texts(rng, 120)
    rows = []
    for i, (words, new) in enumerate(zip(groups, other, strict=True)):
        n = len(words)
        if i % 2:
            changed = words + new[: n // 6]
        else:
            at = rng.randrange(n - n // 20)
            changed = words[:at] + new[: n // 20] + words[at + n // 20 :]
        assert 0.8 <= jaccard(" ".join(words), " ".join(changed)) < 0.95
        rows += [(i, " ".join(words)), (1000 + i, " ".join(changed))]
    left = {x.doc_id for x in op.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == set(range(120))


def test_near_dedup_leaves_shuffled_blocks(spark):
    rng = random.Random(12)
    rows = []
    for i, words in enumerate(made_texts(rng, 40)):
        size = 10 if i % 2 else 4
        blocks = [words[k : k + size] for k in range(0, len(words), size)]
        rng.shuffle(blocks)
        changed = [w for b in blocks for w in b]
        assert jaccard(" ".join(words), " ".join(changed)) < 0.8
        rows += [(i, " ".join(words)), (1000 + i, " ".join(changed))]
    assert op.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).count() == 80


def test_near_dedup_large_groups_are_compared_whole(spark):
    """Chains in large buckets: the kept rows are those of all pairs' components."""
    rng = random.Random(13)
    base, other = made_texts(rng, 2)
    base = base[:60] * 3
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(words))
            words[at] = rng.choice(other)
        rows.append((i, " ".join(words)))
    root = list(range(150))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    for i in range(150):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    left = {x.doc_id for x in op.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == set(root) and 1 < len(left)


def test_rest_pairs_lose_no_link_between_components(spark):
    """Random sets and components: the prefix filter's candidates, confirmed, are all links between components."""
    rng = random.Random(17)
    sets, comp = [], []
    for group in range(6):
        base = [rng.randrange(1 << 40) for _ in range(rng.randrange(1, 60))]
        for _ in range(40):
            own = {x for x in base if rng.random() > rng.choice([0, 0.05, 0.15])} | {rng.randrange(1 << 40) for _ in range(rng.choice([0, 1, 3, 8]))}
            sets.append(own or {group})
            comp.append(10 * group + rng.randrange(4))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[i] != comp[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    table = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, set array<long>").cache()
    nodes = spark.createDataFrame([(i, len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))], "node long, size long, comp long")
    pairs = op.rest_pairs(nodes, table)
    got = {(r.u, r.v) for r in op.near_pairs(pairs, table).collect()}
    assert got == want and len(want) > 100
    assert pairs.count() < len(sets) * (len(sets) - 1) // 4


def test_nulls_short_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  TWO"), (6, "one two three"), (7, long), (8, long + " more"), (8, long + " more"), (None, "lone"), (None, None)]
    left = op.near_dedup(spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, node long, `h.set` string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in left) == [-1, 1, 4, 6, 7]
    assert left[0].asDict().keys() == {"doc_id", "text", "node", "h.set"}
