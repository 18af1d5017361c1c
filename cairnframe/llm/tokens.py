"""Public byte-level BPE vocabularies for the operators that count or write token ids."""

from __future__ import annotations

import base64
import functools

#: A parameter everywhere; the file stays where it is.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The id after the vocabulary's last: ends every document and fills the last sequence of one.
END = 50256
#: The vocabulary's own pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """One per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
