"""Edit-aware token counts.

A document's state is a tree over its pre-tokens (the pieces that the vocabulary's pattern cuts a text into; byte-pair merges
never cross them): leaves hold the length and the token count of runs of pre-tokens, inner nodes the sums of their subtrees.  The
root is the document's count.  An edit replaces characters [start, end) by other text.  Only the pre-tokens it can touch are cut
and encoded anew: from the first one whose end, or the character after it, reaches the edit (it may grow, or its look-ahead change) up
to the first boundary after the edit that is an old boundary too - the pattern looks only forward, so from there all pieces are
the old ones.  The leaves between are replaced, and the sums above them updated.

Texts are read once, in Arrow batches, one tree at a time; nothing is shuffled.  States can be kept in a column of their own
(:func:`build`) and updated later (:func:`update`).

Defined cases: null and empty texts count 0 tokens; edits are applied in order of (start, end), must not overlap (else
ValueError) and are clipped to the text; repeated rows are counted each by itself; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .tokens import PATTERN, VOCABULARY, encoding

LEAF = 64
#: Counts of pre-tokens that a worker remembers; it forgets all and goes on when they are more.
REMEMBER = 400_000

#: What the registered query edits, as a pipeline's redaction would: e-mail addresses and long numbers.
REDACT = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|[0-9]{4,}+"


class Counter:
    """Token counts of pre-tokens, remembered."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import regex

        self.pattern = regex.compile(PATTERN)
        self.encode = encoding(vocabulary).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > REMEMBER:
                known.clear()
            for i, n in enumerate(out):
                if n is None:
                    piece = pieces[i]
                    out[i] = known[piece] = len(self.encode(piece))
        return out


class CountTree:
    """Sums of lengths and token counts over runs of pre-tokens; ``sums[1]`` is the root, node i has children 2i and 2i + 1."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self._build([(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])])

    def _build(self, leaves) -> None:
        self.leaves = leaves
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.size)
        for i, (lengths, counts) in enumerate(leaves):
            self.sums[self.size + i] = (sum(lengths), sum(counts))
        for i in range(self.size - 1, 0, -1):
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a + c, b + d)

    @property
    def total(self) -> int:
        return self.sums[1][1]

    def pieces(self) -> int:
        return sum(len(x) for x, _ in self.leaves)

    def ending(self, pos: int) -> tuple[int, int, int, int]:
        """The first pre-token that ends at ``pos`` or later: (leaf, index in it, its start, its end).  pos is within the text."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if before + self.sums[node][0] < pos or not self.sums[node][0]:
                before += self.sums[node][0]
                node += 1
        leaf = node - self.size
        ends = list(accumulate(self.leaves[leaf][0], initial=before))
        i = bisect_left(ends, pos, 1) - 1
        return leaf, i, ends[i], ends[i + 1]

    def splice(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Put new pre-tokens in place of those from ``first`` to ``last`` = (leaf, index), both included."""
        (a, i), (b, j) = first, last
        after = [x[j + 1 :] for x in self.leaves[b]]
        before = [x[:i] for x in self.leaves[a]]
        for k in range(a + 1, b + 1):
            self.leaves[k] = ([], [])
        self.leaves[a] = (before[0] + lengths + after[0], before[1] + counts + after[1])
        for k in range(a, b + 1):
            self.sums[self.size + k] = (sum(self.leaves[k][0]), sum(self.leaves[k][1]))
        low, high = (self.size + a) // 2, (self.size + b) // 2
        while low:
            for k in range(low, high + 1):
                (p, q), (r, s) = self.sums[2 * k], self.sums[2 * k + 1]
                self.sums[k] = (p + r, q + s)
            low, high = low // 2, high // 2
        if len(self.leaves[a][0]) > 16 * LEAF:  # an insertion this long gets leaves of its own
            lengths = [x for y, _ in self.leaves for x in y]
            counts = [x for _, y in self.leaves for x in y]
            self.__init__(lengths, counts)

    def dump(self) -> bytes:
        import numpy as np

        lengths = np.array([x for y, _ in self.leaves for x in y], dtype="<u4")
        counts = np.array([x for _, y in self.leaves for x in y], dtype="<u4")
        return zlib.compress(lengths.tobytes() + counts.tobytes(), 1)

    @classmethod
    def load(cls, state: bytes) -> CountTree:
        import numpy as np

        both = np.frombuffer(zlib.decompress(state), dtype="<u4").reshape(2, -1).tolist()
        return cls(both[0], both[1])


def tree_of(text: str | None, counter: Counter) -> CountTree:
    pieces = counter.pattern.findall(text or "")
    return CountTree(list(map(len, pieces)), counter.count(pieces))


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def apply_edits(tree: CountTree, text: str, edits: list[tuple[int, int, str]], counter: Counter) -> tuple[str, int]:
    """Update ``tree`` in place; return the new text and how many pre-tokens were encoded anew."""
    edits = sorted((min(a, len(text)), min(b, len(text)), new) for a, b, new in edits)
    if any(a > b for a, b, _ in edits) or any(x[1] > y[0] for x, y in zip(edits, edits[1:], strict=False)):
        raise ValueError("edits overlap")
    new_text = edited(text, edits)
    if not text or not edits:
        if edits:
            fresh = tree_of(new_text, counter)
            tree._build(fresh.leaves)
            return new_text, fresh.pieces()
        return new_text, 0
    patches, shift, i = [], 0, 0
    while i < len(edits):
        leaf, index, old, _ = tree.ending(max(1, edits[i][0] - 1))
        first, at, stop, pieces = (leaf, index), old + shift, edits[i][1], []
        shift += len(edits[i][2]) - (edits[i][1] - edits[i][0])
        i += 1
        while True:
            back = at - shift  # where this place was in the old text
            if back >= stop:
                if back >= len(text):
                    back = len(text)
                    if at >= len(new_text) and i == len(edits):
                        last = tree.ending(len(text))[:2]
                        break
                if i < len(edits) and (back >= edits[i][0] or tree.ending(max(1, edits[i][0] - 1))[2] < back):
                    # the next edit touches what was cut anew: go on through it
                    stop = edits[i][1]
                    shift += len(edits[i][2]) - (edits[i][1] - edits[i][0])
                    i += 1
                    continue
                leaf, index, _, end = tree.ending(max(1, back))
                if end == back and pieces is not None and (at > 0 or back > 0):
                    last = (leaf, index)
                    break
            if at >= len(new_text):
                last = tree.ending(len(text))[:2]
                break
            m = counter.pattern.match(new_text, at)
            pieces.append(m.group())
            at = m.end()
        patches.append((first, last, pieces))
    anew = 0
    for first, last, pieces in reversed(patches):  # from the right: places to the left stay where they are
        anew += len(pieces)
        if last < first:  # nothing replaced: put in before ``first``
            last = (first[0], first[1] - 1)
        tree.splice(first, last, list(map(len, pieces)), counter.count(pieces))
    return new_text, anew


def build(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, state: the count and the tree of every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                trees = [tree_of(t, counter) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([t.total for t in trees], pa.int64()), pa.array([t.dump() for t in trees], pa.binary())], names=["doc_id", "n_tokens", "state"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, state binary")


def update(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """From rows (doc_id, text, state, edits array<struct<start int, end int, new string>>): doc_id, text, n_tokens, n_reencoded, state, all after the edits."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, text, state, edits in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    tree = CountTree.load(state)
                    new, anew = apply_edits(tree, text or "", [(e["start"], e["end"], e["new"] or "") for e in edits or ()], counter)
                    out.append((doc_id, new, tree.total, anew, tree.dump()))
                if out:
                    a, b, c, d, e = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.binary())], names=["doc_id", "text", "n_tokens", "n_reencoded", "state"])

    return rows.selectExpr("cast(doc_id as long) doc_id", "text", "state", "edits").mapInArrow(run, "doc_id long, text string, n_tokens long, n_reencoded long, state binary")


def redactions(text: str, pattern) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "[EMAIL]" if "@" in m.group() else "[NUMBER]") for m in pattern.finditer(text)]


def count_redacted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pieces, n_tokens, n_edits, n_reencoded, n_tokens_after: every document counted, redacted, and counted on from its tree."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        counter, redact = Counter(vocabulary), regex.compile(REDACT)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out = []
                for text in some.column(1).to_pylist():
                    tree = tree_of(text, counter)
                    before, size = tree.total, tree.pieces()
                    edits = redactions(text or "", redact)
                    _, anew = apply_edits(tree, text or "", edits, counter)
                    out.append((size, before, len(edits), anew, tree.total))
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_pieces", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, n_tokens long, n_edits long, n_reencoded long, n_tokens_after long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_redacted(documents(spark, sf_dir))
