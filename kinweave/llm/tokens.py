"""Texts in tokens of a public tokenizer, on the workers."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

#: Where the vocabulary files of the public tokenizers lie on every machine; they are read, never copied.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str = TOKENIZER) -> Callable[[str], list[int]]:
    """Text to token ids; strings of special tokens are ordinary text."""
    return _encoding(path).encode_ordinary


def vocabulary(path: str = TOKENIZER) -> int:
    return _encoding(path).max_token_value + 1
