"""Training-order materialisation.

Documents become sequences of ``seq_len`` token ids (uint16, little-endian; every document ends with the end id, and its last
sequence is filled up with it).  A keyed Feistel permutation over [0, N) with cycle-walking gives the sequence with dense number
i its global slot; slots are cut into ranges of ``shard_records``, one range per shard, and a record lies at byte
``slot % shard_records * stride`` of its shard: fixed strides, so a reader can seek to any step and resume there.

The flow keeps one copy of the payload on the move at a time:

1. ``repartition`` by a hash of (doc_id, text) and sort inside partitions: the numbering then depends on the rows, the key and
   the number of buckets only, not on file splits or task order.  A hot doc_id spreads over the partitions by its texts.
2. Tokenise each partition once, write it (zstd-packed) to the shared folder; its rows carry their partition and the number of
   sequences before them in it.  Lost executors cost no second numbering: the table is on shared storage.
3. Sum the sequences per partition: one row per partition comes to the driver (their number is a setting, not the data's) and
   goes back as offsets.
4. Number, permute and cut into records in Arrow batches, send each record to its shard by ``repartitionById``, sort by slot.

Slots are a permutation, so shards are even whatever the data look like.

Defined cases: a null or empty text is a document with the end id alone; null doc_ids are kept; repeated rows are sequences of
their own (equal rows are interchangeable); an empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, partitions, release_shuffles
from .tokens import END, VOCABULARY, encoding

SEQ_LEN = 512
SHARD_RECORDS = 16384
#: Shuffle partitions of the last step, at most; beyond it a partition holds several consecutive shards.
MAX_PARTITIONS = 50_000
KEY = "order-1"
ROUNDS = 6

RECORD_SCHEMA = "shard long, slot long, byte_offset long, doc_id long, seq_no int, n_tokens int, record binary"


def round_keys(key: str, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little") for r in range(rounds)]


def half_bits(n: int) -> int:
    """Bits of each Feistel half: the domain is the smallest 4**b that holds n, so a walk takes fewer than 4 steps on average."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _mix(x, k):
    """A 64-bit finaliser of multiply and xor-shift steps."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def permute(index, n: int, key: str = KEY, rounds: int = ROUNDS):
    """Slots of dense numbers (int64 arrays): a bijection of [0, n)."""
    import numpy as np

    bits, keys = half_bits(n), round_keys(key, rounds)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)

    def once(v):
        left, right = v >> shift, v & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return (left << shift) | right

    out = once(np.asarray(index).astype(np.uint64))
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def unpermute(slot, n: int, key: str = KEY, rounds: int = ROUNDS):
    """Dense numbers of slots."""
    import numpy as np

    bits, keys = half_bits(n), round_keys(key, rounds)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)

    def once(v):
        left, right = v >> shift, v & mask
        for k in reversed(keys):
            left, right = right ^ (_mix(left, k) & mask), left
        return (left << shift) | right

    out = once(np.asarray(slot).astype(np.uint64))
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def tokenise(docs: DataFrame, seq_len: int, vocabulary: str, buckets: int) -> DataFrame:
    """(part, before, n_seqs, doc_id, n_tokens, ids): a row per document, its ids zstd-packed; ``before`` counts the sequences that precede it in its partition."""
    schema = "part int, before long, n_seqs int, doc_id long, n_tokens int, ids binary"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        enc, pack = encoding(vocabulary), zstandard.ZstdCompressor(level=3)
        part, before = TaskContext.get().partitionId(), 0
        arrow = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_seqs", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = enc.encode_ordinary(text or "")
                    ids.append(END)
                    n = -(-len(ids) // seq_len)
                    rows.append((part, before, n, doc_id, len(ids), pack.compress(np.array(ids, dtype="<u2").tobytes())))
                    before += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    return keyed.repartition(buckets, "h").sortWithinPartitions("h", "doc_id").select("doc_id", "text").mapInArrow(run, schema)


def offsets(tokens: DataFrame) -> tuple[dict[int, int], int]:
    """The first dense number of every partition, and N.  One row per partition reaches the driver."""
    out, n = {}, 0
    for part, k in sorted(tokens.groupBy("part").agg(F.sum("n_seqs").alias("k")).collect()):
        out[part], n = n, n + k
    return out, n


def records(docs: DataFrame, seq_len: int = SEQ_LEN, shard_records: int = SHARD_RECORDS, key: str = KEY, vocabulary: str = VOCABULARY, buckets: int | None = None) -> DataFrame:
    """One row per slot (:data:`RECORD_SCHEMA`): partition = shard, sorted by slot; ``record`` holds ``seq_len`` ids."""
    spark = docs.sparkSession
    tokens = materialise(tokenise(docs, seq_len, vocabulary, partitions(docs, buckets)), "op3-tokens")
    release_shuffles(spark)
    starts, n = offsets(tokens)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack, stride = zstandard.ZstdDecompressor(), 2 * seq_len
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                part, before, n_seqs, doc_id, n_tokens, ids = (some.column(i) for i in range(6))
                counts = n_seqs.to_numpy().astype(np.int64)
                if not counts.size:
                    continue
                first = before.to_numpy() + np.array([starts[p] for p in part.to_pylist()], dtype=np.int64)
                row = np.repeat(np.arange(counts.size), counts)
                seq = np.arange(row.size) - np.repeat(np.cumsum(counts) - counts, counts)
                slot = permute(first[row] + seq, n, key)
                whole = np.full(int(counts.sum()) * seq_len, END, dtype="<u2")
                begin = (np.cumsum(counts) - counts) * seq_len
                for b, x in zip(begin.tolist(), ids.to_pylist(), strict=True):
                    got = np.frombuffer(unpack.decompress(x), dtype="<u2")
                    whole[b : b + got.size] = got
                used = np.minimum(n_tokens.to_numpy()[row] - seq * seq_len, seq_len)
                record = pa.Array.from_buffers(pa.binary(stride), row.size, [None, pa.py_buffer(whole.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot // shard_records), pa.array(slot), pa.array(slot % shard_records * stride), doc_id.take(pa.array(row)), pa.array(seq.astype(np.int32)), pa.array(used.astype(np.int32)), record],
                    names=["shard", "slot", "byte_offset", "doc_id", "seq_no", "n_tokens", "record"],
                )

    shards = max(1, -(-n // shard_records))
    each = -(-shards // min(shards, MAX_PARTITIONS))
    out = tokens.mapInArrow(run, RECORD_SCHEMA)
    return out.repartitionById(-(-shards // each), F.expr(f"cast(shard div {each} as int)")).sortWithinPartitions("slot")


def write_shards(rows: DataFrame, folder: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """Write ``shard-NNNNNNNN.bin`` files under ``folder`` (a URI that executors share) and return shard, first_slot, n_records, n_bytes, sha256.

    ``rows`` are those of :func:`records`.  A shard is written under a name of the attempt and renamed when whole, so that
    repeated or speculative attempts leave one correct file.  Compute the result once: reading it is what writes.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt, shard, first, count, digest, out = TaskContext.get().taskAttemptId(), None, 0, 0, None, None

        def close():
            out.close()
            store.move(f"{root}/.shard-{shard:08d}.{attempt}", f"{root}/shard-{shard:08d}.bin")
            return pa.RecordBatch.from_pydict({"shard": [shard], "first_slot": [first], "n_records": [count], "n_bytes": [count * 2 * seq_len], "sha256": [digest.hexdigest()]})

        for batch in batches:
            for s, slot, record in zip(batch.column("shard").to_pylist(), batch.column("slot").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if s != shard:
                    if shard is not None:
                        yield close()
                    shard, first, count, digest = s, slot, 0, hashlib.sha256()
                    out = store.open_output_stream(f"{root}/.shard-{shard:08d}.{attempt}")
                if slot != first + count:
                    raise ValueError("a shard's rows must come in slot order")
                out.write(record)
                digest.update(record)
                count += 1
        if shard is not None:
            yield close()

    return rows.mapInArrow(run, "shard long, first_slot long, n_records long, n_bytes long, sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the training order, its payload included."""
    return records(documents(spark, sf_dir))
