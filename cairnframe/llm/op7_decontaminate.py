"""Benchmark decontamination by latent semantic retrieval.

The benchmark is a stated query set.  Its items come to the driver in groups of at most ``GROUP`` and each group makes one pass
over the documents, so a larger benchmark costs more passes and not more memory.

1. Document frequencies of the items' words, and of all words hashed to ``BUCKETS``, over *all* documents: partial counts per
   task, summed by word.  The same pass writes every text's hashed words, two bytes each.
2. A randomised SVD of the TF-IDF passages of *all* distinct texts (rows of the same hashed words are one text, so that copies do not
   fill the space) over the hashed vocabulary: executors form A'(A O) for a Gaussian O, then Y = A'(A Q) for its orthonormal basis Q, and
   Y (Q'Y)^-1 Y' (Nystroem) has the leading right singular vectors.  Items and windows are projected on these, whether the benchmark has
   their words or not: that is the latent space.
3. Every document is cut into overlapping windows of words at the scales its items need.  A window's vector is a
   difference of prefix sums.  Candidates are windows at a cosine of ``LATENT`` or more to an item in the latent space, and those
   at ``COSINE`` or more by the items' own words (postings), so that neither a paraphrase in other words nor an item that the
   singular vectors hardly see falls out.  Those with too few of an item's words for any subsequence that confirms are passed over,
   which loses nothing.  Nothing is capped or sampled here.
4. A candidate is confirmed by the longest common subsequence of words, in one and a half times the item's length somewhere in
   the window or just beside it: ``LCS`` of the item's words, or ``LCS_WITH_ANSWER`` of them if ``ANSWER`` of its last words (where an item has its answer) are there too.

Words are lower-cased; ASCII punctuation separates.  Texts are never shuffled; their hashed words are, once.

Defined cases: null, empty and blank texts and items match nothing; items under ``SHORTEST`` words must be there entire and in
one piece; repeated rows and repeated items each count; null doc_ids are searched like others; long texts are searched whole, a
span of words at a time; empty tables give no hits; extra columns are ignored by :func:`hits`, and :func:`clean` keeps all columns of
what it keeps, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import repeat
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_scratch, materialise

COSINE = 0.35
LATENT = 0.8
LCS = 0.7
LCS_WITH_ANSWER, ANSWER = 0.55, 0.8
SHORTEST = 6
#: Words in more than this share of the documents are left out of the vectors (not of the checks).
COMMON = 0.1
FIT_WINDOW = 64
#: Bytes of hashed words handled at once (or one text), passages in one matrix product, parts in which executors sum a matrix, and
#: tasks a core that make one: the matrices shuffled grow with the cores, not with the documents.
FIT_BYTES = 1 << 20
FIT_ROWS = 24
FIT_PARTS = 64
FIT_TASKS = 2
RANK = 32
BUCKETS = 1 << 14
GROUP = 1024
SMALLEST_WINDOW = 16

_SPACES = bytes(32 if c < 33 or 33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()


def window_of(n: int) -> int:
    """A window for items of n words: a power of two of which n is half at most; windows half a window apart then hold it all somewhere."""
    w = SMALLEST_WINDOW
    while w < 2 * n:
        w *= 2
    return w


def lcs_length(masks: dict, full: int, words) -> int:
    """Bit-parallel longest common subsequence; ``masks`` has the positions of each of the item's words."""
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return (full & ~v).bit_count()


class Item:
    def __init__(self, item_id, words: list[bytes]):
        self.item_id, self.words = item_id, words
        self.window = window_of(len(words))
        self.masks, self.full = self._masks(words)
        self.distinct = frozenset(words)
        self.spare = len(words) - math.ceil(LCS_WITH_ANSWER * len(words))  # words that a confirmed window may lack
        self.answer = words[-max(3, len(words) // 4) :]
        self.answer_masks, self.answer_full = self._masks(self.answer)

    @staticmethod
    def _masks(words):
        masks: dict = {}
        for i, w in enumerate(words):
            masks[w] = masks.get(w, 0) | 1 << i
        return masks, (1 << len(words)) - 1

    def check(self, words: list[bytes], start: int) -> tuple[float, float] | None:
        """(share of the item, share of its answer) at the best place in the window at ``start``, if they confirm it."""
        near = words[max(0, start - self.window // 8) : start + self.window + self.window // 8]
        n = len(self.words)
        if len(self.distinct) - len(self.distinct.intersection(near)) > self.spare:  # then no subsequence is long enough
            return None
        if n < SHORTEST:
            return (1.0, 1.0) if any(near[i : i + n] == self.words for i in range(len(near) - n + 1)) else None
        best = None
        # words far apart are no paraphrase: look at one and a half times the item's length at once
        for low in range(0, max(1, len(near) - n), max(1, n // 4)):
            part = near[low : low + n + n // 2]
            if len(self.distinct) - len(self.distinct.intersection(part)) > self.spare:
                continue
            lcs = lcs_length(self.masks, self.full, part) / n
            if lcs < LCS_WITH_ANSWER or (best and lcs <= best[0]):
                continue
            answer = lcs_length(self.answer_masks, self.answer_full, part) / len(self.answer)
            if lcs >= LCS or answer >= ANSWER:
                best = (lcs, answer)
        return best


def buckets_of(words: list[bytes]):
    """The hashed vocabulary's number of each word."""
    import numpy as np

    return np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words)) & np.uint32(BUCKETS - 1)


class Latent:
    """The leading singular vectors over the hashed vocabulary: ``space`` has a weighted row for each bucket."""

    def __init__(self, idf, vectors):
        import numpy as np

        # the last row is for places without a word
        self.space = np.concatenate([idf[:, None] * vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)

    def of(self, words: list[bytes]):
        return _unit(self.space[buckets_of(words)].sum(axis=0, keepdims=True))[0]


def _unit(vectors):
    import numpy as np

    return vectors / np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-12)[:, None]


class Scale:
    """The items that one window size serves: postings of their words, and their places in the latent space."""

    def __init__(self, window: int, items: list[Item], numbers: list[int], idf: dict, ids: dict, latent: Latent):
        import numpy as np

        self.window, self.stride, self.items, self.numbers = window, window // 2, items, numbers
        postings: dict[int, list] = {}
        need = []
        for k, item in enumerate(items):
            weights: dict = {}
            for w in item.words:
                if w in idf:
                    weights[w] = weights.get(w, 0.0) + idf[w]
            norm = math.sqrt(sum(x * x for x in weights.values())) or 1.0
            for w, x in weights.items():
                postings.setdefault(ids[w], []).append((k, x * idf[w] / norm))
            need.append(self._least(item, idf))
        self.need = np.array(need)
        self.counts = np.array([len(postings.get(i, ())) for i in range(len(ids) + 1)])
        self.first = np.cumsum(self.counts) - self.counts
        flat = [x for i in range(len(ids) + 1) for x in postings.get(i, ())]
        self.item = np.array([x[0] for x in flat], dtype=np.int64)
        self.weight = np.array([x[1] for x in flat])
        self.latent = np.array([latent.of(i.words) for i in items], dtype=np.float32)

    @staticmethod
    def _least(item: Item, idf: dict) -> int:
        """Any common subsequence that confirms has so many words of the postings at least, as the others are in them once at most."""

        def rare(share: float, words: list[bytes]) -> int:
            return math.ceil(share * len(words) - 1e-9) - sum(w not in idf for w in words)

        if len(item.words) < SHORTEST:
            return rare(1.0, item.words)
        return min(rare(LCS, item.words), max(rare(LCS_WITH_ANSWER, item.words), rare(ANSWER, item.answer)))

    def candidates(self, place, got, squares, low: int, high: int, n: int, latent_sums, limits: tuple[float, float]):
        """(item, start, cosine) of the windows that start in words low:high of n; ``latent_sums()`` gives prefix sums by ``UNIT`` words from ``low``."""
        import numpy as np

        stride = self.stride
        starts = np.arange(low, min(high, max(n - stride, 1)), stride)
        if not starts.size:
            return
        width = starts.size + 3  # a block before the first window, one behind the last
        a, b = np.searchsorted(place, [low - stride, low + (width - 1) * stride])
        block, word = (place[a:b] - low) // stride + 1, got[a:b]
        per = self.counts[word]
        at = np.repeat(self.first[word], per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        cell = self.item[at] * width + np.repeat(block, per)
        shape, size = (len(self.items), width), len(self.items) * width
        count = np.bincount(cell, None, size).reshape(shape)
        enough = count[:, :-3] + count[:, 1:-2] + count[:, 2:-1] + count[:, 3:] >= self.need[:, None]
        rows = np.flatnonzero(enough.any(axis=1))  # most items have too few words here
        if not rows.size:
            return
        share = np.bincount(cell, self.weight[at], size).reshape(shape)[rows]
        square = np.bincount(block, squares[word], width)
        cosine = (share[:, 1:-2] + share[:, 2:-1]) / np.sqrt(np.maximum(square[1:-2] + square[2:-1], 1e-12))
        step, sums = stride // UNIT, latent_sums()
        begin = np.arange(starts.size) * step
        near = self.latent[rows] @ _unit(sums[np.minimum(begin + 2 * step, len(sums) - 1)] - sums[begin]).T >= limits[1]
        k, w = np.nonzero(enough[rows] & (near | (cosine >= limits[0])))
        yield from zip(rows[k].tolist(), starts[w].tolist(), cosine[k, w].tolist(), strict=True)


SPAN = 1 << 15
#: Words in a block of latent sums: half the smallest window.
UNIT = SMALLEST_WINDOW // 2


class Searcher:
    """The items of one pass; a word is looked up once for all of them."""

    def __init__(self, items: list[Item], idf: dict, latent: Latent, limits: tuple[float, float] = (COSINE, LATENT)):
        import numpy as np

        self.items, self.latent, self.limits = items, latent, limits
        own = sorted({w for i in items for w in i.words if w in idf})
        self.ids = {w: k for k, w in enumerate(own, 1)}
        self.squares = np.array([0.0, *(idf[w] ** 2 for w in own)])
        sizes = sorted({i.window for i in items})
        self.scales = [Scale(w, [i for i in items if i.window == w], [k for k, i in enumerate(items) if i.window == w], idf, self.ids, latent) for w in sizes]

    def _sums(self, buckets):
        """Latent prefix sums by blocks of ``UNIT`` words."""
        import numpy as np

        part = self.latent.space.take(buckets, axis=0)
        sums = np.zeros((len(part) // UNIT + 1, part.shape[1]), dtype=np.float32)
        np.cumsum(part.reshape(-1, UNIT, part.shape[1]).sum(axis=1), axis=0, out=sums[1:])
        return sums

    def hits(self, text: str | None) -> Iterator[tuple]:
        """(item_id, cosine, lcs, answer, start) of the best confirmed window of each item."""
        for _, *x in self.hits_of([words_of(text)]):
            yield tuple(x)

    def hits_of(self, texts: list[list[bytes]]) -> Iterator[tuple]:
        """The same for some texts' words, each after the text's number.

        Texts lie one behind the other with a gap of the largest window, so that no window has words of two of them.
        """
        import numpy as np

        gap = self.scales[-1].window
        sizes = np.array([-(-len(w) // gap) * gap + gap for w in texts])
        offsets = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        ids = np.zeros(total, dtype=np.int64)
        for at, words in zip(offsets.tolist(), texts, strict=True):
            if words:
                ids[at : at + len(words)] = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))

        def buckets(low: int, high: int):
            """Of the words from ``low`` to ``high``, texts and gaps."""
            out = np.full(high - low, BUCKETS, dtype=np.int64)
            for t in range(max(0, int(np.searchsorted(offsets, low, side="right")) - 1), int(np.searchsorted(offsets, high))):
                at = int(offsets[t])
                if words := texts[t][max(0, low - at) : high - at]:
                    at = max(at, low) - low
                    out[at : at + len(words)] = buckets_of(words)
            return out

        place = np.flatnonzero(ids)
        got = ids[place]
        found: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for low in range(0, total, SPAN):  # a span at a time, with the largest window's overlap
            sums = cache(lambda low=low: self._sums(buckets(low, min(low + SPAN, total) + gap)))  # where they are asked for
            for scale in self.scales:
                for k, start, cosine in scale.candidates(place, got, self.squares, low, low + SPAN, total, sums, self.limits):
                    t = int(np.searchsorted(offsets, start + scale.window, side="left")) - 1
                    i, start = scale.numbers[k], max(0, start - int(offsets[t]))
                    verdict = self.items[i].check(texts[t], start)
                    if verdict and ((t, i) not in found or (verdict[0], cosine) > (found[t, i][1], found[t, i][0])):
                        found[t, i] = (cosine, *verdict, start)
        for (t, i), x in found.items():
            yield (t, self.items[i].item_id, *x)

    def batches(self, texts: Iterator[str | None]) -> Iterator[list[list[bytes]]]:
        """The texts' words in groups of some ``SPAN`` words."""
        some, n = [], 0
        for text in texts:
            some.append(words_of(text))
            n += len(some[-1])
            if n >= SPAN:
                yield some
                some, n = [], 0
        if some:
            yield some


def _load(benchmark: DataFrame) -> Iterator[list[Item]]:
    """Groups of items; the driver holds one group at a time."""
    group: list[Item] = []
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        if words := words_of(r.text):
            group.append(Item(r.item_id, words))
        if len(group) == GROUP:
            yield group
            group = []
    if group:
        yield group


def _frequencies(docs: DataFrame, vocabulary: dict, hashed: bool) -> tuple[dict, dict, int, DataFrame | None]:
    """Documents that have each word of the vocabulary, each bucket (if ``hashed``), and those with words: all of them are counted.

    If ``hashed``, the last is a table of the buckets of every text's words, a row for each text with words.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def rows(ids: list, word: list, n: list):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(word, pa.int64()), pa.array(n, pa.int64())], names=["ids", "word", "n"])

        size = len(vocabulary)
        counts, n = np.zeros(size + BUCKETS * hashed, dtype=np.int64), 0
        for batch in batches:
            texts = []
            for text in batch.column(0):
                words = words_of(text.as_py())
                n += bool(words)
                counts[[vocabulary[w] for w in vocabulary.keys() & set(words)]] += 1
                if hashed and words:
                    ids = buckets_of(words)
                    counts[size + ids] += 1  # a bucket of several words counts once
                    texts.append(ids.astype("<u2").tobytes())
            if texts:
                yield rows(texts, [None] * len(texts), [None] * len(texts))
        at = np.flatnonzero(counts)
        yield rows([None] * (at.size + 1), [*at.tolist(), -1], [*counts[at].tolist(), n])

    out = docs.select("text").mapInArrow(run, "ids binary, word long, n long")
    if hashed:
        out = materialise(out, "op7-words")
    rows = out.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r.word: r.n for r in rows.collect()}  # one row for each word of the group and each bucket
    n, size = got.pop(-1, 0), len(vocabulary)
    return {k: v for k, v in got.items() if k < size}, {k - size: v for k, v in got.items() if k >= size}, n, out if hashed else None


def _gram(texts: DataFrame, idf, base):
    """A'(A ``base``) of the TF-IDF passages A of all ``texts`` (their words' buckets)."""
    import numpy as np

    shape, small = base.shape, base.astype(np.float32)
    weights = idf.astype(np.float32)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out, column = np.zeros(shape), np.zeros(BUCKETS, dtype=np.int64)

        def add(texts: list[bytes]) -> None:
            sums = np.zeros(shape, dtype=np.float32)
            sizes = np.array([len(x) // 2 for x in texts])
            ids = np.frombuffer(b"".join(texts), dtype="<u2")
            passages = -(-sizes // FIT_WINDOW)  # of each text: none has words of two texts
            gaps = np.repeat((np.cumsum(passages) - passages) * FIT_WINDOW - (np.cumsum(sizes) - sizes), sizes)
            heavy = np.flatnonzero(weights.take(ids) > 0)
            row = (heavy + gaps.take(heavy)) // FIT_WINDOW
            ids = ids.take(heavy).astype(np.int64)
            lows = np.arange(0, int(passages.sum()), FIT_ROWS)
            ends = np.searchsorted(row, lows + FIT_ROWS).tolist()
            for low, begin, end in zip(lows.tolist(), [0, *ends], ends, strict=False):
                some = ids[begin:end]
                own = np.flatnonzero(np.bincount(some, minlength=BUCKETS) > 0)
                column[own] = np.arange(own.size)
                cell = (row[begin:end] - low) * own.size + column.take(some)
                a = np.bincount(cell, minlength=FIT_ROWS * own.size).astype(np.float32).reshape(FIT_ROWS, -1)
                a *= weights.take(own)
                y = a @ small.take(own, axis=0)
                y /= np.maximum(np.einsum("ij,ij->i", a, a), 1e-24)[:, None]  # passages of unit length, on both sides
                y = a.T @ y
                y += sums.take(own, axis=0)
                sums[own] = y
            np.add(out, sums, out=out)

        for batch in batches:
            texts, size = [], 0
            for x in batch.column(0):
                texts.append(x.as_py())
                size += len(texts[-1])
                if size >= FIT_BYTES:
                    add(texts)
                    texts, size = [], 0
            if texts:
                add(texts)
        for part, rows in enumerate(np.array_split(out.astype(np.float32), FIT_PARTS)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["part", "m"])

    def summed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for part, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(m.as_py(), dtype=np.float32).astype(np.float64)
                sums[part] = sums[part] + rows if part in sums else rows
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "m"])

    out = np.zeros(shape)
    parts = np.array_split(out, FIT_PARTS)
    schema = "part int, m binary"
    texts = texts.coalesce(FIT_TASKS * texts.sparkSession.sparkContext.defaultParallelism)
    for r in texts.mapInArrow(run, schema).repartition(FIT_PARTS, "part").mapInArrow(summed, schema).collect():  # one matrix, whatever the tasks
        parts[r.part][:] = np.frombuffer(bytes(r.m)).reshape(parts[r.part].shape)
    return out


def _fit(texts: DataFrame, counts: dict, n: int, seed: int = 11) -> Latent:
    """The leading singular vectors of all distinct texts' passages by a randomised SVD."""
    import numpy as np

    df = np.zeros(BUCKETS)
    df[list(counts)] = list(counts.values())
    idf = np.where((df > 0) & (df <= max(COMMON * n, 20)), np.log((1 + n) / (1 + df)) + 1, 0.0)
    distinct = materialise(texts.where("ids IS NOT NULL").select("ids").distinct(), "op7-texts")
    drop_scratch(texts)
    rng = np.random.Generator(np.random.PCG64(seed))
    q = np.linalg.qr(_gram(distinct, idf, rng.standard_normal((BUCKETS, RANK + 8))))[0]
    y = _gram(distinct, idf, q)
    drop_scratch(distinct)
    core = q.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    some = values > 1e-6 * max(values.max(initial=0), 1e-12)
    if not some.any():
        return Latent(idf, np.zeros((BUCKETS, 0)))
    vectors, roots, _ = np.linalg.svd(y @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)
    return Latent(idf, vectors[:, :RANK][:, roots[:RANK] ** 2 > 1e-6 * roots[0] ** 2])


def models(docs: DataFrame, benchmark: DataFrame, limits: tuple[float, float] = (COSINE, LATENT)) -> Iterator[Searcher]:
    """A fitted searcher for each pass over the documents."""
    latent = None
    for group in _load(benchmark):
        vocabulary = {w: i for i, w in enumerate(sorted({w for i in group for w in i.words}))}
        df, hashed, n, texts = _frequencies(docs, vocabulary, latent is None)
        latent = latent or _fit(texts, hashed, n)
        idf = {w: math.log((1 + n) / (1 + df.get(i, 0))) + 1 for w, i in vocabulary.items() if df.get(i, 0) <= max(COMMON * n, 20)}
        yield Searcher(group, idf, latent, limits)


def hits(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, latent: float = LATENT) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, word_at: a row per document and item that it gives away (its best window)."""
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double, word_at long"
    out = docs.sparkSession.createDataFrame([], schema)

    def search(searcher: Searcher):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("word_at", pa.int64())])
            for batch in batches:
                rows, ids = [], batch.column(0).to_pylist()
                for some in searcher.batches(x.as_py() for x in batch.column(1)):
                    rows += [(ids[t], *x) for t, *x in searcher.hits_of(some)]
                    ids = ids[len(some) :]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

        return run

    for searcher in models(docs, benchmark, (cosine, latent)):
        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search(searcher), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that give no item away."""
    at = docs.columns.index("text")

    def without(searcher: Searcher):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                keep: list[bool] = []
                for some in searcher.batches(x.as_py() for x in batch.column(at)):
                    bad = {t for t, *_ in searcher.hits_of(some)}
                    keep += [t not in bad for t in range(len(some))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    out = docs
    for searcher in models(docs, benchmark):
        out = out.mapInArrow(without(searcher), docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "cosine", "lcs", "answer")
