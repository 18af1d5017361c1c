"""Repeated strings by merging Burrows-Wheeler transforms of shards: the method named for :mod:`.op9_repeats`, for small corpora.

A shard is the transform of its documents, each ended by a sentinel of its own.  Two shards merge by iterative interleave
refinement: starting from "all of the first, then all of the second", a pass sorts the interleave stably by the symbols it has just
read, after which it is right for suffixes up to one symbol more.  Where a border between suffixes first appears tells their common
prefix.  No suffix is ever sorted again.  Strings of ``length`` bytes need ``length`` passes over all bytes for each of log2(shards) levels:
the README has the rate, and why :mod:`.op9_repeats` does not use this on a corpus.
"""

from __future__ import annotations


class Shard:
    """bwt: symbols (byte + 1, 0 for a sentinel) in suffix order; doc, pos: where each suffix starts; n: documents."""

    def __init__(self, bwt, doc, pos, n: int):
        self.bwt, self.doc, self.pos, self.n = bwt, doc, pos, n


def of_document(text: bytes, doc: int) -> Shard:
    """By prefix doubling over one text."""
    import numpy as np

    s = np.append(np.frombuffer(text, dtype=np.uint8).astype(np.int64) + 1, 0)
    rank, k = s, 1
    while True:
        ahead = np.append(rank[k:], np.zeros(min(k, s.size), dtype=np.int64))[: s.size]
        order = np.lexsort((ahead, rank))
        fresh = np.append(0, np.cumsum((rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])))
        rank = np.empty_like(fresh)
        rank[order] = fresh
        if fresh[-1] == s.size - 1 or k > s.size:
            break
        k *= 2
    return Shard(s[order - 1].astype(np.uint16), np.full(s.size, doc), order, 1)


def merge(a: Shard, b: Shard, length: int):
    """The merged shard and the common prefix of each suffix with the one before it, up to ``length``."""
    import numpy as np

    z = np.repeat(np.array([0, 1], dtype=np.uint8), [a.bwt.size, b.bwt.size])
    ends = np.repeat(np.array([0, 1], dtype=np.uint8), [a.n, b.n])
    m = a.n + b.n
    prefix = np.full(z.size, length, dtype=np.int64)
    prefix[0] = 0
    block = np.zeros(z.size, dtype=np.int64)

    def read(interleave):
        out = np.empty(interleave.size, dtype=np.uint16)
        out[interleave == 0], out[interleave == 1] = a.bwt, b.bwt
        return out

    for step in range(length):
        symbols = read(z)
        inner = np.flatnonzero(symbols)
        order = inner[np.argsort(symbols[inner], kind="stable")]
        fresh = np.concatenate([ends, z[order]])
        # sentinels differ from all else; other suffixes where their first symbol or the rest differs
        border = np.ones(z.size, dtype=bool)
        c, r = symbols[order], block[order]
        border[m + 1 :] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])
        prefix[border & (prefix == length)] = step
        new_block = np.cumsum(border)
        if (fresh == z).all() and (new_block == block).all():
            break
        z, block = fresh, new_block
    first = z == 0

    def both(x, y):
        out = np.empty(z.size, dtype=x.dtype)
        out[first], out[~first] = x, y
        return out

    return Shard(read(z), both(a.doc, b.doc), both(a.pos, b.pos), m), prefix


def repeated_spans(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Per text the (start, end) of every string of ``length`` bytes that also starts elsewhere, unmerged."""
    import numpy as np

    if not texts:
        return []
    shards = [of_document(t, i) for i, t in enumerate(texts)] + [of_document(b"", -1)]  # at least one merge
    prefix = None
    while len(shards) > 1:
        pairs = [merge(*shards[i : i + 2], length) if i + 1 < len(shards) else (shards[i], prefix) for i in range(0, len(shards), 2)]
        shards, prefix = [p[0] for p in pairs], pairs[-1][1]
    same = np.append(prefix >= length, False)
    hit = same[:-1] | same[1:]  # a suffix in a run of equal prefixes: a repeated interval
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, p in zip(shards[0].doc[hit].tolist(), shards[0].pos[hit].tolist(), strict=True):
        out[d].append((p, p + length))
    return out
