"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: 64 majority bits over the XXH64 of a text's word shingles.  Two fingerprints link at ``radius`` or fewer differing
bits; components of links are the groups.

Equal fingerprints collapse first, so groups of exact copies cost one row.  With ``radius`` 3, two linked fingerprints agree in
one of four 16-bit blocks at least: each distinct fingerprint goes to four buckets (block, value).  A bucket above ``HOT`` rows is
split again by the same argument over its remaining 48, then 36 bits, so no bucket has to fit one task however alike the texts
are, and no link is lost.  Inside a bucket the fingerprints, sorted by their rank in the reflected Gray code, form the leaves of
a tree: every upper node keeps the bits that all its leaves share (mask and pattern), less those its parent already has.  A
search adds up the differences on the way down and leaves a whole group as soon as they exceed the radius.  A bucket emits a
spanning forest of its links, never its pairs; distributed large-star/small-star steps join the forests.

Defined cases: texts of one or two words are one shingle; null, empty and blank texts have fingerprint zero and link with each
other like any others; null doc_ids take part, and a component's id is its smallest non-null doc_id (null if it has none);
repeated rows get the same result; an empty table gives no rows; extra columns are ignored.  Near copies of whole texts, at a
Jaccard similarity of 0.8, are the business of :mod:`.op5_near`, which searches by this index first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_scratch, materialise, partitions
from .graph import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Buckets above this size are split by further blocks.
HOT = 4096
FAN = 8

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of a UTF-8 text, as an unsigned number."""
    import numpy as np
    from xxhash import xxh64_intdigest

    # bytes.split() separates at exactly \x20 and \x09-\x0D
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]  # noqa: B905
    h = np.array([xxh64_intdigest(p, seed) for p in parts], dtype=">u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > h.size).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                got = np.array([fingerprint(t, shingle, seed) for t in some.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fps):
    """Rank of each code word (uint64) in the reflected Gray code."""
    import numpy as np

    r = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """A static tree over distinct fingerprints, sorted by Gray rank; numpy arrays per level."""

    def __init__(self, fps, fan: int = FAN):
        import numpy as np

        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.fan = fan
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask, pattern = np.full(self.fps.size, full), self.fps
        self.levels = [(mask, pattern)]  # leaves first
        while mask.size > fan:
            at = np.arange(0, mask.size, fan)
            every = np.bitwise_and.reduceat(mask, at)
            first = pattern[at]
            differ = np.bitwise_or.reduceat(pattern ^ np.repeat(first, np.diff(np.append(at, mask.size))), at)
            mask = every & ~differ
            pattern = first & mask
            self.levels.append((mask, pattern))
        # what a node knows beyond its parent
        self.own = [m & ~np.repeat(self.levels[i + 1][0], fan)[: m.size] if i + 1 < len(self.levels) else m for i, (m, _) in enumerate(self.levels)]

    def search(self, queries, radius: int = RADIUS):
        """(query number, leaf number) of all matches; ``leaf`` counts in Gray order."""
        import numpy as np

        top = self.levels[-1][0].size
        q = np.repeat(np.arange(queries.size), top)
        node = np.tile(np.arange(top), queries.size)
        acc = np.zeros(q.size, dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            acc = acc + np.bitwise_count((queries[q] ^ self.levels[level][1][node]) & self.own[level][node])
            keep = acc <= radius
            q, node, acc = q[keep], node[keep], acc[keep]
            if level:
                below = self.levels[level - 1][0].size
                child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                ok = child < below
                q, acc, node = np.repeat(q, self.fan)[ok], np.repeat(acc, self.fan)[ok], child[ok]
        return q, node


def _roots(n: int, a, b):
    """Smallest index of each index's component."""
    import numpy as np

    label = np.arange(n)
    while a.size:
        least = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == old).all():
            break
    return label


def bucket_links(keys, fps, radius: int = RADIUS):
    """Spanning links among the rows of whole buckets, as two arrays of row numbers."""
    import numpy as np

    order = np.lexsort((gray_rank(fps), keys))
    left, right = [], []
    k, f = keys[order], fps[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    sizes = np.diff(np.append(starts, k.size))
    small = np.repeat(sizes <= FAN, sizes)
    for d in range(1, FAN):  # buckets of one node: neighbours in it
        i = np.flatnonzero((k[:-d] == k[d:]) & small[:-d]) if k.size > d else np.zeros(0, dtype=np.int64)
        i = i[np.bitwise_count(f[i] ^ f[i + d]) <= radius]
        left.append(order[i])
        right.append(order[i + d])
    for s, n in zip(starts[sizes > FAN].tolist(), sizes[sizes > FAN].tolist(), strict=True):
        index = GrayIndex(f[s : s + n])  # already in Gray order
        rows = order[s : s + n]
        seen = np.arange(n)
        for at in range(0, n, 256):
            q, leaf = index.search(index.fps[at : at + 256], radius)
            q = q + at
            forward = leaf > q
            q, leaf = q[forward], leaf[forward]
            seen = _roots(n, np.append(q, np.arange(n)), np.append(leaf, seen))
        moved = np.flatnonzero(seen != np.arange(n))
        left.append(rows[moved])
        right.append(rows[seen[moved]])
    a, b = np.concatenate(left), np.concatenate(right)
    label = _roots(keys.size, a, b)
    moved = np.flatnonzero(label != np.arange(keys.size))
    return moved, label[moved]


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """(key, fp, rest) -> four rows each: the key grown by one block of ``width // 4`` bits, the rest without it."""
    size = width // 4

    def one(b: int) -> Column:
        value = F.shiftrightunsigned("rest", b * size).bitwiseAND(F.lit((1 << size) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << (b * size)) - 1))
        high = F.shiftleft(F.shiftrightunsigned("rest", (b + 1) * size), b * size) if b < 3 else F.lit(0).cast("long")
        others = [F.col(c) for c in rows.columns if c not in ("key", "rest")]
        return F.struct(((F.col("key") * 4 + b) * (1 << size) + value).alias("key"), high.bitwiseOR(low).alias("rest"), *others)

    return rows.select(F.explode(F.array(*[one(b) for b in range(4)])).alias("x")).select("x.*")


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges u, v: a spanning forest of every bucket's links.  ``fps`` has distinct fingerprints in column fp, which are the nodes."""
    if radius > 3:
        raise ValueError("four blocks find links of at most three differing bits")
    rows = fps.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp")
    ready = None
    for width in (64, 48, 36):
        rows = _blocks(rows, width)
        if width > 36:
            heavy = materialise(rows.groupBy("key").count().where(F.col("count") > hot).select("key"), "op5-hot")
            if heavy.isEmpty():
                ready, rows = (rows if ready is None else ready.unionByName(rows)), None
                break
            cool = rows.join(heavy, "key", "left_anti")
            ready = cool if ready is None else ready.unionByName(cool)
            rows = rows.join(heavy, "key", "left_semi")
    if rows is not None:
        ready = ready.unionByName(rows)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def link(keys, got):
            a, b = bucket_links(keys, got, radius)
            signed = got.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], names=["u", "v"])

        held = None
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held[0].size > 50_000 and (end := int(np.searchsorted(held[0], held[0][-1]))):  # the last bucket may go on
                yield link(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if held is not None and held[0].size:
            yield link(*held)

    return ready.select("key", "fp").repartition(partitions(fps), "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach)."""
    prints = materialise(fingerprints(docs, shingle, seed), "op5-prints")
    return _classes(prints, radius)[0]


def _classes(prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """``prints`` with component_id, and (fp, root, component_id) of the distinct fingerprints."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "op5-distinct")
    found = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "op5-rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("fp", "root", "component_id"), "op5-named")
    drop_scratch(distinct, rooted)
    return prints.join(named.select("fp", "component_id"), "fp"), named


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
