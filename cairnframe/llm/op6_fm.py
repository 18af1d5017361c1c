"""Quality classifier: a factorisation machine.

Inputs of a score are hashed words (their shares of the text, signed hashing into ``BUCKETS``), structure statistics of the text,
and the one neutral piece of metadata, ``n_chars``.  Labels, language, source and doc_id are never among them.  The model is

    y = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),     score = 1 / (1 + exp(-y)),

so pairwise interactions of all features cost time linear in the non-zero ones.

Fitting: labelled rows whose crc32(doc_id) mod 5 is not 0; of these the ``SAMPLE`` first by a hash of the id, if there are more (a
documented bound, so the fit takes the same time and driver memory at any size).  Their features are computed on the executors;
the driver gets sparse vectors and runs Adam with fixed seeds in fixed order, hence reruns agree.  Scoring reads every whole text
once in Arrow batches with the model (some 100 KB) in the closure; nothing is shuffled.

Defined cases: null and empty texts have no words and are scored by their (zero) statistics; null doc_ids are not held out and
never train; several labels of a doc_id count as the lowest; without labels of both classes every score is the mean label (0.5
if there is none); repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BUCKETS = 2048
RANK = 8
#: Labelled rows that a fit takes at most.
SAMPLE = 6000
THRESHOLD = 0.3
EPOCHS = 60

_PUNCT = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
STATS = 18


def statistics(raw: bytes, words: list[bytes], n_chars: int | None) -> list[float]:
    """Structure of a text, each number of the order of one."""
    import math

    n, size = max(1, len(words)), max(1, len(raw))

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    lengths = list(map(len, words))
    mean = sum(lengths) / n
    return [
        math.log1p(len(words)) / 8,
        math.log1p(n_chars or 0) / 10,
        mean / 8,
        max(lengths, default=0) / 40,
        10 * share(_SYMBOLS),
        10 * share(_UPPER),
        share(_LOWER),
        10 * share(_DIGITS),
        10 * share(_PUNCT),
        20 * share(b"!?"),
        20 * share(b"|"),
        20 * share(b'"=_/\\{}[]()'),
        10 * share(b"."),
        distinct / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        math.log1p(len(lines)) / 5,
        (len(raw) - len(raw.translate(None, bytes(range(128, 256))))) / size * 4,
        float(not words),
    ]


def features(raw: bytes | None, n_chars: int | None):
    """(indices, values): hashed words, then statistics at BUCKETS and up."""
    import numpy as np

    raw = raw or b""
    words = raw.split()
    stats = np.array(statistics(raw, words, n_chars), dtype=np.float32)
    index = np.arange(BUCKETS, BUCKETS + STATS)
    if not words:
        return index, stats
    h = np.fromiter(map(zlib.crc32, raw.translate(_TO_LOWER).split()), dtype=np.uint32, count=len(words))
    sums = np.bincount(h % BUCKETS, weights=1.0 - 2.0 * (h >> 31), minlength=BUCKETS)
    at = np.flatnonzero(sums)
    return np.concatenate([at, index]), np.concatenate([(sums[at] / np.sqrt(len(words)) / 4).astype(np.float32), stats])


class Model:
    def __init__(self, w0: float, w, v):
        self.w0, self.w, self.v = w0, w, v

    def score(self, index, value) -> float:
        import math

        v = self.v[index] * value[:, None]
        s = v.sum(axis=0)
        y = self.w0 + float(self.w[index] @ value) + 0.5 * float(s @ s - (v * v).sum())
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, y))))


def fit(rows: list[tuple], rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Rows (index, value, label), in a fixed order."""
    import numpy as np

    size = BUCKETS + STATS
    labels = np.array([float(r[2]) for r in rows])
    if not rows or labels.min() == labels.max():
        p = min(max(float(labels.mean()) if rows else 0.5, 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))), np.zeros(size, np.float32), np.zeros((size, rank), np.float32))
    x = np.zeros((len(rows), size), dtype=np.float32)
    for i, (index, value, _) in enumerate(rows):
        x[i, index] = value
    rng = np.random.Generator(np.random.PCG64(seed))
    p = [np.array([np.log(labels.mean() / (1 - labels.mean()))], dtype=np.float32), np.zeros(size, np.float32), (rng.standard_normal((size, rank)) * 0.02).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    decay, step = (0.0, 1e-4, 1e-3), 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 128):
            b = order[at : at + 128]
            xb = x[b]
            xv = xb @ p[2]
            y = p[0][0] + xb @ p[1] + 0.5 * ((xv**2).sum(axis=1) - (xb**2) @ (p[2] ** 2).sum(axis=1))
            g = ((1 / (1 + np.exp(-np.clip(y, -60, 60)))) - labels[b]).astype(np.float32) / len(b)
            grads = [g.sum(keepdims=True), xb.T @ g, xb.T @ (g[:, None] * xv) - p[2] * ((xb**2).T @ g)[:, None]]
            step += 1
            for i in range(3):
                d = grads[i] + decay[i] * p[i]
                m[i] = 0.9 * m[i] + 0.1 * d
                s[i] = 0.999 * s[i] + 0.001 * d * d
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return Model(float(p[0][0]), p[1].astype(np.float32), p[2].astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _inputs(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).select("doc_id", "quality")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            got = [features(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())],
                names=["doc_id", "quality", "i", "v"],
            )

    # at most ``sample`` ids
    rows = _inputs(docs).join(F.broadcast(marks), "doc_id").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text", "n_chars")
    import numpy as np

    got = rows.mapInArrow(run, "doc_id long, quality int, i binary, v binary").collect()
    unique = {}
    for r in sorted(got, key=lambda r: (r.doc_id, bytes(r.i), bytes(r.v))):  # a repeated doc_id trains once
        unique.setdefault(r.doc_id, (np.frombuffer(bytes(r.i), np.int32), np.frombuffer(bytes(r.v), np.float32), int(r.quality > 0)))
    return fit(list(unique.values()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                got = [model.score(*features(t, n)) for t, n in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    inputs = _inputs(docs)
    return inputs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_chars").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
