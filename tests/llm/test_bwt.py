"""Merged transforms against comparing all strings."""

import random

import pytest

from cairnframe.llm import bwt
from cairnframe.llm.op9_repeats import merged


def brute(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    out = [[] for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d].append((i, i + length))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_repeated_spans(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 30, 60]))) for _ in range(rng.choice([0, 1, 2, 5, 8]))]
    if seed % 3 == 0 and texts:
        texts.append(texts[0])
    for length in (1, 3, 6):
        assert [merged(x) for x in bwt.repeated_spans(texts, length)] == [merged(x) for x in brute(texts, length)]
