import hashlib
import random
import re

import pytest

from cairnframe.llm import op2_pii as op

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(RULES.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(3)
    bits = ["a@b.co", "_c@d.org", "%", "+", ".", "-", "1", "23", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+44", "192.168.0.1", "256.1.1.1", "0001.2.3.4.5.6.7.8", "é", "😀", " ", "\n", "x", "@", "@x.y", "..", "(", ")", "00", "378282246310005"]
    fixed = [None, "", "a@b.com_c@d.org", "a@b.c.@d.e", "x" * 5000 + "@", "1" * 6000, "1.2.3.4" * 50, "😀 a@b.co 😀 +1 555 123 4567", "@@@", "a@b", "+" * 300, "9 " * 5000, "1.1.1.1 " * 900, "a.b." * 3000 + "@q.r"]
    return fixed + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(400)]


def test_base_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, row int")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in op.find(docs).collect()}
    for i, t in rows:
        assert got[i] == brute(t), t[:200]


def test_contexts_discover(spark, tmp_path):
    rng = random.Random(1)
    cards = [c for c in (f"{rng.randrange(10**15, 10**16)}" for _ in range(400)) if luhn(c)][:12]
    rows = [f"some plain prose the Account: {c} and the rest of it" for c in cards]
    rows += ["other prose, account: ZX-99812-Q. end", "the 77812345 of nothing", "of the number 5551234 x"]
    rows += ["the plain prose and the rest " * 5] * 5
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    at = rows[12].index("ZX")
    assert got[12].spans == f"context:{at}:{at + len('ZX-99812-Q')}"
    assert got[13].spans == got[14].spans == ""
    for i in range(12):
        want = f"card:{rows[i].index(cards[i])}:{rows[i].index(cards[i]) + 16}"
        assert got[i].spans == want and got[i].n_card == 1 and got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[16].base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None)]])
def test_empty(spark, rows):
    out = op.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and all(not r.spans for r in out)


def test_discoveries_teach_patterns(spark):
    rng = random.Random(4)
    cards = [c for c in (f"{rng.randrange(10**15, 10**16)}" for _ in range(400)) if luhn(c)][:12]
    rows = [f"some plain prose the Account: {c} and the rest of it" for c in cards]
    ids = [f"ZX-99{i}12-Q" for i in range(6)]
    rows += [f"other prose, account: {x} end" for x in ids] + [f"now comes member {x} too" for x in ids]
    rows += ["so says member QK-77123-B at once", "only 5551234 of it"]
    got = {r.doc_id: r.spans for r in op.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    at = rows[24].index("QK")
    assert [tuple(s) for s in got[24]] == [(at, 4, at + len("QK-77123-B"))]
    assert got[25] == []


def test_long_neighbours_and_wide_gaps_are_contexts(spark):
    rng = random.Random(5)
    cards = [c for c in (f"{rng.randrange(10**15, 10**16)}" for _ in range(400)) if luhn(c)][:12]
    long = "Account" + "x" * 100 + ":"
    rows = [f"plain {long} {c} rest" for c in cards[:6]] + [f"plain Holder:{' ' * 100}\t{c} rest" for c in cards[6:]]
    rows += [f"other {long} ZX-99812-Q end", f"other Holder:\n{' ' * 90}QK-77123-B end"]
    got = {r.doc_id: r.spans for r in op.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, inst in ((12, "ZX-99812-Q"), (13, "QK-77123-B")):
        at = rows[i].index(inst)
        assert [tuple(s) for s in got[i]] == [(at, 4, at + len(inst))]


def brute_graph(texts, support=3, confidence=0.5, shortest=5):
    """Spans of kind ``context`` by plain loops over the same definitions."""
    occ, words = [], {}
    for row, text in enumerate(texts):
        text = text or ""
        base = brute(text)
        low = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        for w in [*low, *(f"{a} {b}" for a, b in zip(low, low[1:]))]:
            words[w] = words.get(w, 0) + 1
        hits = []
        at = 0
        group = r"[()+.-]*[0-9][0-9()+.-]*(?![^\x20\x09-\x0D])"
        pattern = re.compile(rf"(?<![^\x20\x09-\x0D])(?:{group}(?:\x20{group})*|[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*)")
        while m := pattern.search(text, at):
            hits.append((m.start(), m.end()))
            at = m.end()
        for i, (a, b) in enumerate(hits):
            m = text[a:b]
            strip = re.match(r"[\W_]*", m)[0]
            inst = re.sub(r"^[\W_]+|[\W_]+$", "", m).lower()
            if len(inst) < shortest:
                continue
            start, end = a + len(strip), a + len(strip) + len(inst)
            left = re.findall(r"[^\x20\x09-\x0D]+", text[hits[i - 1][1] if i else 0 : a].lower())
            right = re.findall(r"[^\x20\x09-\x0D]+", text[b : hits[i + 1][0] if i + 1 < len(hits) else len(text)].lower())
            pats = ["L" + " ".join(left[-k:]) for k in (1, 2) if len(left) >= k] + ["R" + " ".join(right[:k]) for k in (1, 2) if len(right) >= k]
            occ.append((row, start, end, inst, pats, any(s < end and e > start for s, _, e in base)))
    based = {o[3] for o in occ if o[5]}
    seeds = based | {o[3] for o in occ if re.fullmatch("[0-9a-f]{32,}", o[3])}
    edges = {}
    for o in occ:
        for p in o[4]:
            edges.setdefault(p, {}).setdefault(o[3], 0)
            edges[p][o[3]] += 1
    told = {}
    for _ in range(60):
        scores = told | dict.fromkeys(seeds, 1.0)
        conf = {}
        for p, insts in edges.items():
            c = min(0.999, sum(n * scores.get(i, 0) for i, n in insts.items()) / (words[p[1:]] + 1))
            if c >= confidence and sum(scores.get(i, 0) >= confidence for i in insts) >= support:
                conf[p] = c
        told = {}
        for p, c in conf.items():
            for i in edges[p]:
                told[i] = 1 - (1 - told.get(i, 0)) * (1 - c)
    fresh = {i for i, s in told.items() if s >= confidence} - based
    return sorted((row, start, end) for row, start, end, inst, _, base in occ if not base and inst in fresh)


def context_spans(out):
    return sorted((r.doc_id, s.start, s.end) for r in out.collect() for s in r.spans if s.k == 4)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graph_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    cards = [c for c in (f"{rng.randrange(10**15, 10**16)}" for _ in range(600)) if luhn(c)][:20]
    plain = ["alpha", "Beta,", "gamma", "the", "of", "Account:", "member", "no.", "key =", "token"]
    found = [*cards, *(" ".join(c[k : k + 4] for k in range(0, 16, 4)) for c in cards[:6]), "+1 (555) 123-4567", *(f'"{rng.getrandbits(160):040x}"' for _ in range(8)), *(f"ID-{rng.randrange(10**6)}" for _ in range(12)), "123 45 6789", "99", "x1"]
    texts = [" ".join(rng.choice(found) if rng.random() < 0.25 else rng.choice(plain) for _ in range(rng.randrange(1, 25))) for _ in range(120)]
    texts += [f"the Account: {rng.choice(found)} beta" for _ in range(60)] + [f"gamma key = {rng.choice(found)}\n" for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_graph(texts)
    assert context_spans(op.find(docs)) == want and len(want) > 10


def test_spaced_groups_are_one_instance(spark):
    rng = random.Random(6)
    cards = [c for c in (f"{rng.randrange(10**15, 10**16)}" for _ in range(400)) if luhn(c)][:9]
    rows = ["pay by card " + " ".join(c[k : k + 4] for k in range(0, 16, 4)) + " now" for c in cards] + ["pay by card 123 45 6789 now", "pay by cash 123 45 6780 now"]
    got = {r.doc_id: r.spans for r in op.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[9]] == [(12, 4, 23)]


def test_discoveries_on_the_test_table(spark):
    """The keys after ``token =`` are found, and little else."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = context_spans(op.find(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    want = {(r.doc_id, m.start(1), m.end(1)) for r in rows for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text or "")}
    assert want and len(want & set(got)) >= 0.95 * len(want) and len(set(got) - want) <= 0.05 * len(got)
