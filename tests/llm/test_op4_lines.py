"""Line dedup against a brute-force version."""

import random

from cairnframe.llm import op4_lines

SCHEMA = "doc_id long, text string, row string, `a.b` int"


def brute(rows):
    """(doc_id, text left) by comparing the lines themselves; ``rows`` in input order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        text = rows[i][1]
        lines = (text or "").split("\n")
        real = [k for k, x in enumerate(lines) if x.strip(" \t\n\r\v\f")]
        gone = set()
        for a in range(len(real) - 2):
            w = tuple(lines[k] for k in real[a : a + 3])
            if w in seen:
                gone |= set(real[a : a + 3])
            seen.add(w)
        out[i] = (rows[i][0], None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(real), len(gone))
    return sorted(out.values(), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    lines = [f"line {i}" for i in range(12)] + ["", "  ", "\t", "é" * 50]
    rows = [(rng.choice([None, i, i]), rng.choice([None, "", "x", "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 30)))]), "r", i) for i in range(120)]
    rows += [(500, "a\nb\nc\nd", "r", 1), (501, "z\nb\n\nc\nd\ny", "r", 2), (502, "q\nq\nq\nq\nq", "r", 3), (503, "\n".join(f"long {i}" for i in range(50_000)), "r", 4)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = op4_lines.dedup(docs)
    assert got.columns == docs.columns
    found = sorted(((x.doc_id, x.text) for x in got.collect()), key=str)
    assert found == sorted(((a, b) for a, b, _, _ in brute(rows)), key=str)
    counts = sorted(((x.doc_id, x.n_lines, x.n_removed) for x in op4_lines.cleaned(op4_lines.numbered(docs)).collect()), key=str)
    assert counts == sorted(((a, n, g) for a, _, n, g in brute(rows)), key=str)


def test_what_goes(spark):
    rows = [(1, "a\nb\nc\nd", "", 0), (2, "x\na\nb\n \nc\nd\ny", "", 0), (3, "a\nb", "", 0), (4, "q\nq\nq\nq", "", 0), (5, "a\nb\nc\nd", "", 0)]
    got = {x.doc_id: x.text for x in op4_lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "a\nb\nc\nd", 2: "x\n \ny", 3: "a\nb", 4: "q", 5: ""}


def test_repeated_rows_keep_one(spark):
    rows = [(7, "a\nb\nc", "", 0)] * 5
    assert sorted(x.text for x in op4_lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == ["", "", "", "", "a\nb\nc"]


def test_empty(spark):
    assert op4_lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
