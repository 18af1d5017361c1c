"""Near copies of whole texts: five-word shingles with a Jaccard similarity of 0.8 or more, found on top of :mod:`.op5_simhash`.

Texts of the same words are one node.  Links are always confirmed by the whole sets of 64-bit shingle hashes; what differs is
where candidates come from:

1. SimHash: fingerprints of the five-word shingles within three bits, by the Gray-order index.  A pair at 0.8 differs in ten of 64
   bits on average, so this alone would find few of them.
2. MinHash, for what SimHash misses: pairs that agree in one of ``BANDS`` bands of ``ROWS`` minima.  A pair at similarity J is
   missed with probability (1 - J ** ROWS) ** BANDS, at 0.8 3 in 100,000.  Buckets of ``SMALL`` nodes compare all pairs; of
   larger ones the most central node (that shares its buckets with most others) meets all others, and in ``ROUNDS`` more rounds
   the most central one outside the bucket's largest component meets those of other components.
3. What large buckets leave in several components meets by an exact prefix filter.  All shingles of these nodes are put
   in one order: first those that only one component has, then by frequency.  Two sets that are alike enough share one of their
   first ``size - 0.8 size + 1`` shingles, and their first common shingle, at positions i and j, bounds what they share by
   ``min(size_u - i, size_v - j)``.  Nodes with many shingles of their own thus meet nobody, and none of a bucket's pairs is
   left out that could be a link between components.  In each shingle's list the largest component only meets the others.

So comparisons follow the number of nodes and of near links, not the square of a bucket, and nothing is capped.

Defined cases: fewer than five words are one shingle; null, empty and blank texts are copies of each other; the smallest doc_id of a
group stays, null doc_ids come last; of rows that share doc_id and text one stays; an empty table gives no rows; all columns
are kept, whatever their names; texts of any length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialise
from .graph import components
from .op5_simhash import _LOWER, SEED, links

SHINGLE = 5
#: The least Jaccard similarity of a link, as a fraction.
NEAR = (4, 5)
BANDS = 20
ROWS = 4
SMALL = 8
ROUNDS = 2


def normalised(text: bytes | None) -> list[bytes]:
    """The words that shingles are made of."""
    return (text or b"").translate(_LOWER).split()


def near_shingles(words: list[bytes]):
    """The set of five-word shingles as sorted 64-bit hashes; fewer words are one shingle, no words none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.array([xxh64_intdigest(x, SEED) for x in words], dtype=np.uint64)
    n = min(SHINGLE, w.size)
    h = np.full(w.size - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = (h ^ w[i : w.size - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def majority(shingles) -> int:
    """The SimHash of a set of hashes, as a signed number."""
    import numpy as np

    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, shingles.size, 65536):
        ones += np.unpackbits(shingles[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > shingles.size).tobytes(), "big", signed=True)


def band_keys(shingles, bands: int = BANDS, rows: int = ROWS):
    """One key for each band of MinHash values (int64); none for the empty set."""
    import numpy as np

    if not shingles.size:
        return np.zeros(0, dtype=np.int64)
    rng = np.random.default_rng(SEED)
    salt, factor = rng.integers(0, 2**64, (2, bands * rows, 1), dtype=np.uint64)
    factor |= np.uint64(1)
    least = np.full(bands * rows, 2**64 - 1, dtype=np.uint64)
    for at in range(0, shingles.size, 1024):
        least = np.minimum(least, ((shingles[at : at + 1024] ^ salt) * factor).min(axis=1))
    key = np.arange(bands, dtype=np.uint64)
    for part in least.reshape(bands, rows).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def text_key(words: list[bytes]) -> bytes:
    """The same for texts of the same words only."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def _slices(batches: Iterator, n: int = 512) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def _prints(inputs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, size (of the set of shingles), fp, keys of every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in _slices(batches):
            words = [normalised(t) for t in some.column(1).to_pylist()]
            sets = [near_shingles(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array([text_key(w) for w in words], pa.binary()), pa.array([s.size for s in sets], pa.int64()), pa.array([majority(s) for s in sets], pa.int64()), pa.array([band_keys(s, bands, rows) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "size", "fp", "keys"],
            )

    return inputs.mapInArrow(run, "doc_id long, text_key binary, size long, fp long, keys array<long>")


def _shingle_sets(inputs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, set of the ``wanted`` nodes (node, first_id, text_key); the texts move once, found by their ids."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in _slices(batches):
            node, text, key = (c.to_pylist() for c in some.columns)
            words = [normalised(t) for t in text]
            own = [i for i, w in enumerate(words) if text_key(w) == key[i]]
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in own], pa.int64()), pa.array([near_shingles(words[i]).view("int64") for i in own], pa.list_(pa.int64()))], names=["node", "set"])

    def by_id(c: str) -> list[Column]:
        return [F.col(c).isNull().alias("none"), F.coalesce(c, F.lit(0)).alias("id")]

    # a hash join at every size: sorting would sort the texts, too
    found = inputs.select(*by_id("doc_id"), "text").join(wanted.select(*by_id("first_id"), "node", "text_key").hint("shuffle_hash"), ["none", "id"])
    return found.select("node", "text", "text_key").mapInArrow(run, "node long, set array<long>").groupBy("node").agg(F.first("set").alias("set"))


def _sized(a: str, b: str) -> Column:
    return F.least(a, b) * NEAR[1] >= F.greatest(a, b) * NEAR[0]


def near_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets (node, set) are alike enough."""
    left = sets.select(F.col("node").alias("u"), F.col("set").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return pairs.join(left, "u").join(right, "v").where(common * (NEAR[0] + NEAR[1]) >= (F.size("a") + F.size("b")) * NEAR[0]).select("u", "v")


def first_pairs(nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Candidates (u, v): SimHash links, and all pairs of small buckets."""
    fps = materialise(nodes.where("size > 0").groupBy("fp").agg(F.min(F.struct("node", "size")).alias("r")).select("fp", F.col("r.node").alias("node"), F.col("r.size").alias("size")), "near-fps")
    a, b = (fps.select(F.col("fp").alias(x), F.col("node").alias(f"{x}_node"), F.col("size").alias(f"{x}_size")) for x in "uv")
    gray = links(fps.select("fp")).join(a, "u").join(b, "v").where(_sized("u_size", "v_size")).select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v"))
    same = nodes.where("size > 0").join(fps.select("fp", F.col("node").alias("u"), F.col("size").alias("u_size")), "fp").where((F.col("node") > F.col("u")) & _sized("size", "u_size")).select("u", F.col("node").alias("v"))
    few = [buckets.where(F.col("n") <= SMALL).select("key", F.col("node").alias(f"{x}_node"), F.col("size").alias(f"{x}_size")) for x in "uv"]
    small = few[0].join(few[1], "key").where((F.col("v_node") > F.col("u_node")) & _sized("u_size", "v_size")).select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    return gray.unionByName(same).unionByName(small).distinct()


def leader_pairs(large: DataFrame) -> DataFrame:
    """Candidates (u, v): in each bucket of ``large`` (key, node, size, weight, comp) one node with those of other components.

    It is the heaviest outside the bucket's largest component; where each node is a component of its own, the heaviest but the first.
    """
    per = materialise(large.groupBy("key", "comp").agg(F.count("*").alias("k"), F.max(F.struct("weight", "node", "size", "comp")).alias("r")), "near-per-comp")
    most = materialise(per.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("key", F.col("m.comp").alias("most")), "near-most")
    leaders = materialise(per.join(most, "key").where("comp != most").groupBy("key").agg(F.max("r").alias("r")).select("key", F.col("r.node").alias("l"), F.col("r.size").alias("l_size"), F.col("r.comp").alias("l_comp")), "near-leaders")
    out = large.join(leaders, "key").where((F.col("comp") != F.col("l_comp")) & _sized("size", "l_size"))
    return out.select(F.least("node", "l").alias("u"), F.greatest("node", "l").alias("v")).distinct()


def rest_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates (u, v) among ``nodes`` (node, size, comp) in different components: every link between them is one."""
    tokens = materialise(sets.join(nodes, "node").select("node", "size", "comp", F.explode("set").alias("h")), "near-tokens")
    per = materialise(tokens.groupBy("h", "comp").agg(F.count("*").alias("n")), "near-per")
    mixed = per.groupBy("h").agg(F.sum("n").alias("freq"), F.count("*").alias("k"), F.max_by("comp", F.struct("n", "comp")).alias("most")).where("k > 1").select("h", "freq", "most")
    shared = materialise(tokens.join(materialise(mixed, "near-mixed"), "h"), "near-shared")
    own = Window.partitionBy("node")
    at = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("freq", "h")) - 1
    # ceil(0.8 size) shingles at least are shared with any partner
    prefix = shared.select("h", "node", "size", "comp", "most", at.alias("at")).where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * NEAR[0] / NEAR[1]))
    prefix = materialise(prefix, "near-prefix")
    u, v = (prefix.select("h", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "size", "comp", "at")], *([] if x == "v" else ["most"])) for x in "uv")
    most_common = F.least(F.col("u_size") - F.col("u_at"), F.col("v_size") - F.col("v_at"))
    near = (F.col("u_comp") != F.col("v_comp")) & (most_common * (NEAR[0] + NEAR[1]) >= (F.col("u_size") + F.col("v_size")) * NEAR[0])
    once = (F.col("v_comp") == F.col("most")) | (F.col("u_node") < F.col("v_node"))
    out = u.where("u_comp != most").join(v, "h").where(near & once)
    return out.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()


def groups(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id and text_key of every document; text_key, first_id and root of every node: equal roots are one group)."""
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    prints = materialise(_prints(inputs, bands, rows), "near-prints")
    nodes = prints.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "near-nodes")
    each = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = materialise(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-shared-keys")
    buckets = materialise(each.join(shared, "key").select("key", "n", "node", "size"), "near-buckets")
    pairs = materialise(first_pairs(nodes, buckets), "near-pairs")
    weights = buckets.where(F.col("n") > SMALL).groupBy("node").agg(F.sum("n").alias("weight"))
    large = materialise(buckets.where(F.col("n") > SMALL).select("key", "node", "size").join(materialise(weights, "near-weights"), "node"), "near-large")
    # the sets of what is compared now, and of large buckets, which may be compared later
    some = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).unionByName(large.select("node")).distinct()
    sets = materialise(_shingle_sets(inputs, nodes.join(some, "node", "left_semi").select("node", "first_id", "text_key")), "near-sets")
    edges = materialise(near_pairs(pairs, sets), "near-links")
    found = materialise(components(edges), "near-roots")
    for turn in range(ROUNDS + 2):
        named = materialise(large.join(found, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "near-named")
        alive = materialise(named.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("key"), "near-alive")
        if alive.isEmpty():
            break
        named = named.join(alive, "key", "left_semi")
        if turn <= ROUNDS:
            more = leader_pairs(named)
        else:  # whatever is left, by the filter that loses nothing
            more = rest_pairs(materialise(named.select("node", "size", "comp").distinct(), "near-left"), sets)
        edges = edges.unionByName(materialise(near_pairs(materialise(more, "near-more"), sets), "near-links"))
        found = materialise(components(edges), "near-roots")
    drop_scratch(shared, buckets, pairs, sets, large)
    out = materialise(nodes.join(found, "node", "left").select("text_key", "first_id", F.coalesce("root", "node").alias("root")), "near-rooted")
    drop_scratch(nodes)
    return prints.select("doc_id", "text_key"), out


def near_dedup(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The documents, one (the smallest doc_id) of each group of copies and near copies."""
    cols = docs.columns
    prints, rooted = groups(docs, bands, rows)
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("doc_id"), "text_key")).alias("b")
    keep = materialise(rooted.groupBy("root").agg(first).select(F.col("b.doc_id").alias("keep_id"), "b.text_key"), "near-keep")
    # the kept document of each group, found by its id; texts move once, and only one row a group is wanted
    ids = materialise(keep.select("keep_id").where("keep_id IS NOT NULL").distinct(), "near-ids")
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    named = docs.select(row, F.col("doc_id").cast("long").alias("keep_id"), F.xxhash64(*[F.col(f"`{c}`") for c in cols]).alias("h"))
    some = named.join(ids.hint("shuffle_hash"), "keep_id", "left_semi")
    if prints.where("doc_id IS NULL").isEmpty() and prints.count() == prints.select("doc_id").distinct().count():
        return some.select("row.*")  # ids are keys: the common case
    # ids repeat or are missing: text keys tell which of their rows was chosen, and one of equal rows stays
    again = named.where("keep_id IS NULL").unionByName(some)

    def tag(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            key = [text_key(normalised(t)) for t in batch.column("t").to_pylist()]
            yield batch.drop_columns(["t"]).append_column("text_key", pa.array(key, pa.binary()))

    tagged = again.withColumn("t", F.col("row.text").cast("binary")).mapInArrow(tag, again.schema.add("text_key", "binary"))
    chosen = keep.withColumnRenamed("keep_id", "id")
    out = tagged.join(chosen, (tagged.text_key == chosen.text_key) & tagged.keep_id.eqNullSafe(F.col("id"))).select(tagged.text_key, tagged.h, tagged.row)
    return out.groupBy("text_key").agg(F.min_by("row", "h").alias("row")).select("row.*")
