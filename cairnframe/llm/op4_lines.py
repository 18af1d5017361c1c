"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a text (lines of white space alone do not count) are a window.  A window that occurs before, in any
document or the same one, is a repetition; all lines that repetitions cover are removed.  Windows are judged on the input, in the
order of (doc_id, null last; row; line), so the first occurrence of each stays unless windows that came even earlier cover it.

1. The rows get numbers, written once to the shared folder: what follows does not depend on how files are split or tasks are retried.
2. Each line is hashed to 128 bits, three of them to the 128 bits of a window; one narrow row a window is written.
3. Windows are counted by hash (partial sums), and only those that occur twice or more join their counts: a written table on both
   sides, so that a window that a third of the documents share is split between tasks.  The first occurrence is a partial minimum.
4. Later occurrences become a list of window numbers per row.  Texts move once, to join these lists, and each loses the union of the
   covered lines.

Defined cases: null and empty texts have no lines and stay as they are; texts under three lines never lose any; repeated rows
repeat each other (the first of them keeps its lines); null doc_ids come last; an empty table gives no rows; extra columns, also ones
named like this module's own, stay untouched in :func:`dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, drop_scratch, materialise

WINDOW = 3


def line_hashes(lines: list[bytes]):
    """128 bits a line, as an array of two unsigned columns."""
    import numpy as np
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, lines)), dtype="<u8").reshape(-1, 2)


def window_hashes(lines: list[bytes], window: int = WINDOW):
    """128 bits for each run of ``window`` lines."""
    import numpy as np

    h = line_hashes(lines)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros((0, 2), dtype=np.uint64)
    out = np.zeros((n, 2), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            out = (out ^ h[i : i + n]) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
            out ^= out >> np.uint64(31)
            out += out[:, ::-1] * np.uint64(0x165667B19E3779F9)
    return out


def split_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """All lines, and the numbers of those that count."""
    lines = text.split(b"\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def without(text: bytes, starts: list[int], window: int = WINDOW) -> tuple[int, int, int, bytes]:
    """(lines that count, removed ones, removed runs, what is left) after removing the windows that start at the given lines."""
    lines, real = split_lines(text)
    covered = sorted({i for p in starts for i in range(p, p + window)})
    gone = {real[i] for i in covered}
    runs = sum(1 for a, b in zip([-2, *covered], covered, strict=False) if b != a + 1)
    return len(real), len(covered), runs, b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text


def numbered(docs: DataFrame) -> DataFrame:
    """row_no, row (all columns of the input), doc_id, text (bytes): written once."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    out = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.col("text").cast("binary").alias("text"))
    return materialise(out, "op4-rows")


def repeated(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """row_no, starts: the windows of each row that occurred before."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["row_no", "doc_id", "at", "x", "y"]
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                parts = []
                for text in some.column(2).to_pylist():
                    lines, real = split_lines(text or b"")
                    parts.append(window_hashes([lines[i] for i in real], window))
                counts = np.array([len(p) for p in parts])
                at = pa.array(np.repeat(np.arange(len(parts)), counts))
                h = np.concatenate(parts) if parts else np.zeros((0, 2), dtype=np.uint64)
                place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(place.astype(np.int32)), pa.array(h[:, 0].copy().view(np.int64)), pa.array(h[:, 1].copy().view(np.int64))], names=names)

    windows = materialise(rows.select("row_no", "doc_id", "text").mapInArrow(run, "row_no long, doc_id long, at int, x long, y long"), "op4-windows")
    counts = materialise(windows.groupBy("x", "y").agg(F.count("*").alias("n")).where("n >= 2").select("x", "y"), "op4-counts")
    several = materialise(windows.join(counts, ["x", "y"]), "op4-several")
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row_no").alias("c"), F.col("at").alias("d"))
    firsts = materialise(several.groupBy("x", "y").agg(F.min(place).alias("first")), "op4-firsts")
    later = several.join(firsts, ["x", "y"]).where(place != F.col("first")).select("row_no", "at")
    out = materialise(later.groupBy("row_no").agg(F.collect_list("at").alias("starts")), "op4-later")
    drop_scratch(windows, counts, several, firsts)
    return out


def cleaned(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rows`` (of :func:`numbered`) with n_lines, n_removed, n_spans and kept (the bytes left; null for a null text)."""
    joined = rows.join(repeated(rows, window).hint("shuffle_hash"), "row_no", "left").select("doc_id", "row", "text", "starts")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                got = []
                for text, starts in zip(some.column("text").to_pylist(), some.column("starts").to_pylist(), strict=True):
                    n, gone, runs, kept = without(text or b"", starts or [], window)
                    got.append((n, gone, runs, None if text is None else kept))
                columns = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)] if got else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("row"), *columns], names=["doc_id", "row", "n_lines", "n_removed", "n_spans", "kept"])

    schema = StructType([joined.schema["doc_id"], joined.schema["row"]])
    return joined.mapInArrow(run, schema.add("n_lines", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary"))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without repeated lines; every row stays, with the columns it came with."""
    out = cleaned(numbered(docs), window)
    return out.select(*[F.col("kept").cast("string").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaned(numbered(documents(spark, sf_dir).select("doc_id", "text")))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) END AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), w AS (
  SELECT doc_id, k, line AS a, lead(line) OVER v AS b, lead(line, 2) OVER v AS c FROM l WHERE k IS NOT NULL WINDOW v AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS r FROM w WHERE c IS NOT NULL) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, k + o AS k FROM later, range(3) z(o)
), m AS (
  SELECT l.doc_id, l.i, l.line, l.k, gone.k IS NOT NULL AS cut FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = l.k
), r AS (
  SELECT *, CASE WHEN cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY k), false) THEN 1 ELSE 0 END AS start FROM m WHERE k IS NOT NULL
)
SELECT m.doc_id, count(m.k)::BIGINT AS n_lines, count(*) FILTER (m.cut)::BIGINT AS n_removed, coalesce(any_value(s.n), 0)::BIGINT AS n_spans,
  sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (NOT m.cut), '')) AS kept_sha256
FROM m LEFT JOIN (SELECT doc_id, sum(start) AS n FROM r GROUP BY doc_id) s ON s.doc_id = m.doc_id GROUP BY m.doc_id
"""
