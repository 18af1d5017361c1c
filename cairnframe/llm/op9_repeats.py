"""Removal of byte strings that occur more than once anywhere in a corpus.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else; the result is exact.  The same search over
words instead of bytes finds passages of ``PASSAGE`` words that start elsewhere, too: many of them take under 400 bytes, so they
are counted and never cut.  Both searches share every pass; the unit is part of their hashes.

The method asked for, merging shard Burrows-Wheeler transforms by interleave refinement, is in :mod:`.bwt`: it gives the same
spans on small inputs, and the README has the figures why it cannot carry a corpus.  Here the same question is answered
without ordering any suffix:

1. Equal texts collapse to one row with a count (partial aggregation, so copies do not meet in one task).  The rows are written
   once, bucketed by the text's 128-bit key; later joins with narrow tables move those, never the texts again.
2. In every window of ``length`` bytes the ``length // 4``-byte string with the smallest hash (leftmost of equals) is its anchor: equal
   windows have equal anchors at equal offsets.  Windows with one anchor are consecutive; per anchor two hashes are kept, of the
   anchor string and of all bytes its windows cover.
3. An anchor string that occurs once proves its windows unique.  Covered strings that occur twice prove all theirs repeated.
   Only anchors in between go on: one representative for each distinct covered string, with its weight.
4. These split into pieces of ``PIECE`` windows at fixed offsets from the anchor: a hash of what all windows of a piece share
   (once: none is repeated) and one of what they cover together (twice: all are).
5. What is still open splits into single windows, whose 128-bit hashes are counted.

Every step counts with partial sums and joins counts back, so a passage that a third of the documents share is a few rows per
task.  Hashes of 64 bits only ever exclude by counting too much, never too little; a string is called repeated by 128 bits.
Python keeps one text at a time and hashes it in segments of a megabyte.

Defined cases: null and empty texts have no bytes and keep the hash of the empty string; texts under ``length`` bytes are never
touched; repeated rows repeat each other; matches never cross documents; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete_path, documents, drop_scratch, materialise, partitions, release_shuffles, scratch_path

LENGTH = 400
PIECE = 16
#: Repeated passages have over 50 words.
PASSAGE = 51
SEGMENT = 1 << 20

BYTES, WORDS = 0, 1
#: Windows in a piece, by unit.
_PIECES = {BYTES: PIECE, WORDS: 4}
_SPACES = b" \t\n\x0b\x0c\r"

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_TABLES: dict = {}


def _tables(n: int):
    """Per base: byte values, powers and inverse powers modulo 2**64, for texts up to n bytes."""
    import numpy as np

    if _TABLES.get("n", -1) < n:
        n = max(n, 1 << 16)
        made = []
        for i, base in enumerate(_BASES):
            inverse = pow(base, -1, 2**64)
            with np.errstate(over="ignore"):
                power = np.cumprod(np.append(np.uint64(1), np.full(n, base, dtype=np.uint64)))
                back = np.cumprod(np.append(np.uint64(1), np.full(n, inverse, dtype=np.uint64)))
            values = np.random.Generator(np.random.PCG64(1000 + i)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            made.append((values, power, back))
        _TABLES.update(n=n, made=made)
    return _TABLES["made"]


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Hashes of any runs of one array (bytes, or hashes of words) from prefix sums."""

    def __init__(self, raw, which=(0, 1)):
        import numpy as np

        self.made, self.sums = _tables(raw.size), {}
        for i in which:
            values, power, _ = self.made[i]
            s = np.zeros(raw.size + 1, dtype=np.uint64)
            value = values[raw] if raw.dtype == np.uint8 else _mixed(raw ^ values[0]) | np.uint64(1)
            np.cumsum(value * power[: raw.size], out=s[1:])
            self.sums[i] = s

    def of(self, i, start, end):
        import numpy as np

        s = self.sums[i]
        return _mixed((s[end] - s[start]) * self.made[i][2][start] + (end - start).astype(np.uint64))


def hash_spans(raw, start, end, which: int):
    """Hashes of raw[start:end] for arrays of spans, a segment at a time."""
    import numpy as np

    out = np.zeros(start.size, dtype=np.uint64)
    group = start // SEGMENT
    for g in np.unique(group).tolist():
        at = np.flatnonzero(group == g)
        low, high = g * SEGMENT, int(end[at].max())
        out[at] = Hasher(raw[low:high], (which,)).of(which, start[at] - low, end[at] - low)
    return out


def units(text: bytes, unit: int = BYTES):
    """What windows are counted in: the bytes, or a hash of each word."""
    import numpy as np

    raw = np.frombuffer(text, dtype=np.uint8)
    if unit == BYTES:
        return raw
    space = np.zeros(256, dtype=bool)
    space[list(_SPACES)] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space[raw], [True]])))
    return hash_spans(raw, edges[::2], edges[1::2], 0)


def _sliding_minimum(v, w: int):
    """Minima of v[s:s + w] for all s."""
    import numpy as np

    n = v.size - w + 1
    padded = np.full(-(-v.size // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: v.size] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw, length: int = LENGTH):
    """p, a, b, q, e of every anchor: its position, its first and last window, hashes of its string and of raw[a:b + length]."""
    import numpy as np

    found, gram = [], length // 4
    for low in range(0, max(0, raw.size - length + 1), SEGMENT):
        part = raw[low : low + SEGMENT + length - 1]
        h = Hasher(part)
        at = np.arange(part.size - gram + 1)
        q = h.of(0, at, at + gram)
        least = _sliding_minimum((q & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)
        p = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        last = np.append(first[1:], p.size) - 1
        p = p[first]
        found.append((p + low, first + low, last + low, q[p], h.of(1, first, last + length)))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def pieces(raw, p, a, b, length: int = LENGTH, piece: int = PIECE):
    """number of the anchor, lo, hi, c, u of every piece: first and last window, hashes of what its windows share and cover."""
    import numpy as np

    nearest, farthest = (p - b) // piece, (p - a) // piece
    counts = farthest - nearest + 1
    row = np.repeat(np.arange(p.size), counts)
    k = nearest[row] + np.arange(row.size) - np.repeat(np.cumsum(counts) - counts, counts)
    top = p[row] - k * piece
    lo, hi = np.maximum(a[row], top - piece + 1), np.minimum(b[row], top)
    core = hash_spans(raw, top, top - piece + 1 + length, 0)
    cover = hash_spans(raw, lo, hi + length, 1)
    # equal strings at other offsets from their anchors are not compared
    c = _mixed(core + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    u = _mixed(cover + (lo - top).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return row, lo, hi, c, u


def merged(spans):
    """Maximal runs (start, end) of a list of spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


class Texts:
    """The distinct texts of a corpus, bucketed by key in the shared folder: columns key, n (rows that have it), text (bytes)."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.buckets = partitions(docs)
        self.name = "cairnframe_texts_" + uuid.uuid4().hex
        self.path = scratch_path(self.spark, "op9-texts")
        rows = keyed(docs).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
        rows.write.bucketBy(self.buckets, "key").option("path", self.path).option("compression", "zstd").format("parquet").saveAsTable(self.name)
        release_shuffles(self.spark)

    def table(self) -> DataFrame:
        return self.spark.table(self.name).where("octet_length(text) > 0")

    def with_zones(self, zones: DataFrame) -> DataFrame:
        """key, text, zones: each text that has zones, with the list of them; the texts stay in their buckets."""
        some = zones.groupBy("key").agg(F.collect_list("zone").alias("zones"))
        return self.table().select("key", "text").join(some.hint("shuffle_hash"), "key").select("key", "text", "zones")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def keyed(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.unhex(F.md5(raw)).alias("key"), raw.alias("text"))


def _decide(rows: DataFrame, name: str, loose: str, tight: str, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split rows (key, n, place ..., loose, tight) by counts of their hashes.

    Returns the rows whose tight hash counts twice or more, and one representative (key, n = its class's count, place ...) of each
    tight class under a loose hash that counts twice or more and has some class that counts once.
    """
    rows = materialise(rows, name)
    per = rows.groupBy(loose).agg(F.sum("n").alias("w"), F.min(tight).alias("least"), F.max(tight).alias("most")).where("w >= 2")
    # written first: a join straight above an aggregation is one that AQE cannot split where a key is hot
    per = materialise(per.select(loose, (F.col("least") != F.col("most")).alias("mixed")), name + "-counts")
    several = materialise(rows.join(per, loose), name + "-several")
    drop_scratch(rows, per)
    mixed = several.where("mixed")
    by_class = materialise(mixed.groupBy(loose, tight).agg(F.sum("n").alias("w"), F.min(F.struct("key", *place)).alias("r")), name + "-classes")
    repeated = several.where("NOT mixed").select("key", *place).unionByName(mixed.join(by_class.where("w >= 2").select(loose, tight), [loose, tight]).select("key", *place))
    open_ = materialise(by_class.groupBy(loose).agg(F.min("w").alias("fewest")).where("fewest = 1").select(loose), name + "-open")
    return repeated, by_class.join(open_, loose).select(F.col("r.key").alias("key"), F.col("w").alias("n"), *[F.col(f"r.{c}").alias(c) for c in place])


def _batches(batches: Iterator, size: int) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _emit(parts, names, types):
    """One Arrow batch of concatenated numpy columns; unsigned hashes go as signed longs."""
    import numpy as np
    import pyarrow as pa

    columns = []
    for i, t in enumerate(types):
        if t == "key":
            columns.append(pa.array([k for part in parts for k in [part[i]] * len(part[-1])], pa.binary()))
        else:
            whole = np.concatenate([np.broadcast_to(part[i], part[-1].shape) for part in parts])
            columns.append(pa.array(whole.view(np.int64) if whole.dtype == np.uint64 else whole.astype(np.int64)))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _by_unit(zones: list[dict], fields: str) -> Iterator:
    """(unit, arrays of the fields) of a text's zones."""
    import numpy as np

    for unit in sorted({z["unit"] for z in zones}):
        yield unit, tuple(np.array([z[x] for z in zones if z["unit"] == unit], dtype=np.int64) for x in fields.split())


def _tagged(h, unit: int):
    """Hashes that differ between units."""
    import numpy as np

    return h if unit == BYTES else _mixed(h ^ np.uint64(0xA24BAED4963EE407))


def spans(texts: Texts, lengths: dict[int, int]) -> DataFrame:
    """key, unit, lo, hi: spans of repeated strings, not yet merged, for each unit in ``lengths``."""

    def find_anchors(batches: Iterator) -> Iterator:
        import numpy as np

        for some in _batches(batches, 256):
            parts = []
            for key, n, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                for unit, length in lengths.items():
                    p, a, b, q, e = anchors(units(text, unit), length)
                    if p.size:
                        parts.append((key, np.int64(n), np.int64(unit), p, a, b, _tagged(q, unit), _tagged(e, unit)))
            if parts:
                yield _emit(parts, ["key", "n", "unit", "p", "a", "b", "q", "e"], ["key", *"nupabqe"])

    least = min(length if unit == BYTES else 2 * length - 1 for unit, length in lengths.items())
    rows = texts.table().where(F.octet_length("text") >= least).select("key", "n", "text").mapInArrow(find_anchors, "key binary, n long, unit long, p long, a long, b long, q long, e long")
    repeated, rest = _decide(rows, "op9-anchors", "q", "e", ["unit", "p", "a", "b"])
    long = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in lengths.items() for x in kv]), F.col("unit"))
    first = repeated.select("key", "unit", F.col("a").alias("lo"), (F.col("b") + long).alias("hi"))

    def find_pieces(batches: Iterator) -> Iterator:
        for some in _batches(batches, 128):
            parts = []
            for key, text, zones in zip(*(c.to_pylist() for c in some.columns), strict=True):
                for unit, (p, a, b, n) in _by_unit(zones, "p a b n"):
                    row, lo, hi, c, u = pieces(units(text, unit), p, a, b, lengths[unit], _PIECES[unit])
                    parts.append((key, n[row], lo * 0 + unit, lo, hi, _tagged(c, unit), _tagged(u, unit)))
            if parts:
                yield _emit(parts, ["key", "n", "unit", "lo", "hi", "c", "u"], ["key", *"ntlhcu"])

    zones = rest.select("key", F.struct("unit", "p", "a", "b", "n").alias("zone"))
    rows = texts.with_zones(zones).mapInArrow(find_pieces, "key binary, n long, unit long, lo long, hi long, c long, u long")
    repeated, rest = _decide(rows, "op9-pieces", "c", "u", ["unit", "lo", "hi"])
    second = repeated.select("key", "unit", "lo", (F.col("hi") + long).alias("hi"))

    def find_windows(batches: Iterator) -> Iterator:
        import numpy as np

        for some in _batches(batches, 128):
            parts = []
            for key, text, zones in zip(*(c.to_pylist() for c in some.columns), strict=True):
                for unit, (lo, hi, n) in _by_unit(zones, "lo hi n"):
                    counts = hi - lo + 1
                    row = np.repeat(np.arange(lo.size), counts)
                    s = lo[row] + np.arange(row.size) - np.repeat(np.cumsum(counts) - counts, counts)
                    raw, end = units(text, unit), s + lengths[unit]
                    parts.append((key, n[row], s * 0 + unit, s, _tagged(hash_spans(raw, s, end, 0), unit), _tagged(hash_spans(raw, s, end, 1), unit)))
            if parts:
                yield _emit(parts, ["key", "n", "unit", "s", "x", "y"], ["key", *"ntsxy"])

    zones = rest.select("key", F.struct("unit", "lo", "hi", "n").alias("zone"))
    rows = materialise(texts.with_zones(zones).mapInArrow(find_windows, "key binary, n long, unit long, s long, x long, y long"), "op9-windows")
    twice = materialise(rows.groupBy("x", "y").agg(F.sum("n").alias("w")).where("w >= 2").select("x", "y"), "op9-twice")
    third = rows.join(twice, ["x", "y"]).select("key", "unit", F.col("s").alias("lo"), (F.col("s") + long).alias("hi"))
    return first.unionByName(second).unionByName(third)


def covered(found: DataFrame) -> DataFrame:
    """key, n: what the spans of each key cover, overlaps once."""
    before = Window.partitionBy("key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    past = F.coalesce(F.max("hi").over(before), F.lit(0).cast("long"))
    return found.select("key", F.greatest(F.col("hi") - F.greatest("lo", past), F.lit(0).cast("long")).alias("n")).groupBy("key").agg(F.sum("n").alias("n"))


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per distinct text with a repeated string: key, spans (maximal runs), n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    texts = Texts(docs)
    try:
        return materialise(_removed(texts, spans(texts, {BYTES: length}), True), "op9-removed")
    finally:
        texts.drop()


def passages(docs: DataFrame, words: int = PASSAGE) -> DataFrame:
    """key, n of each distinct text with a passage of ``words`` words that starts elsewhere, too: the words that such passages cover."""
    texts = Texts(docs)
    try:
        return materialise(covered(spans(texts, {WORDS: words})), "op9-passages")
    finally:
        texts.drop()


def _removed(texts: Texts, found: DataFrame, with_bytes: bool) -> DataFrame:
    schema = "key binary, spans array<struct<lo:long,hi:long>>, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes

    def cut(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        kind = pa.schema(
            [("key", pa.binary()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
            + [("kept", pa.binary())] * with_bytes
        )
        for some in _batches(batches, 64):
            rows = []
            for key, text, zones in zip(*(c.to_pylist() for c in some.columns), strict=True):
                runs = merged((z["lo"], z["hi"]) for z in zones)
                ends = [0, *(x for run in runs for x in run), len(text)]
                kept = b"".join(text[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2))
                rows.append({"key": key, "spans": [{"lo": a, "hi": b} for a, b in runs], "n_removed": len(text) - len(kept), "n_spans": len(runs), "kept_sha256": hashlib.sha256(kept).hexdigest()} | ({"kept": kept} if with_bytes else {}))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    zones = found.where(F.col("unit") == BYTES).select("key", "lo", "hi").distinct().select("key", F.struct("lo", "hi").alias("zone"))
    return texts.with_zones(zones).mapInArrow(cut, schema)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated bytes cut out of ``text``; a character cut in two by a span's edge becomes U+FFFD.  Other columns stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("key"))
    cuts = removed(docs, length).select("key", "kept")
    out = rows.join(cuts, "key", "left")
    text = F.when(F.col("kept").isNotNull(), F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("row.text"))
    return out.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    texts = Texts(docs)
    try:
        found = spans(texts, {BYTES: LENGTH, WORDS: PASSAGE})
        cuts = materialise(_removed(texts, found, False).drop("spans"), "op9-cuts")
        words = materialise(covered(found.where(F.col("unit") == WORDS)).select("key", F.col("n").alias("n_passage_words")), "op9-passages")
    finally:
        texts.drop()
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    every = docs.select("doc_id", F.unhex(F.md5(raw)).alias("key"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    out = every.join(cuts.join(words, "key", "full_outer"), "key", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")]
    return out.select("doc_id", "n_bytes", *counts, F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("n_passage_words", F.lit(0).cast("long")).alias("n_passage_words"))
