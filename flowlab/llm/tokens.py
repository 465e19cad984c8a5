"""The byte-level tokenizer of the vocabulary file, loaded once per worker.

``tiktoken`` and ``tokenizers`` give the same ids for this vocabulary; the first
is several times faster, the second stays fast on very long unbroken runs, where
it is used instead.  Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import re
from base64 import b64decode
from functools import lru_cache

import numpy as np

LONG_RUN = 2_000
_UNBROKEN = re.compile(rf"\S{{{LONG_RUN},}}|\s{{{LONG_RUN},}}")


def vocabulary(kind: str = "json") -> str:
    """Place of the 50k byte-level vocabulary: ``json`` or ``tiktoken``."""
    import public_tokenizers

    return public_tokenizers.path(f"byte_bpe_50k.{kind}")


class Encoder:
    """Ids of texts, and the number of bytes each id stands for."""

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._steady = Tokenizer.from_file(path)
        self._steady.encode_special_tokens = True
        self.widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for data, rank in ranks.items():
            self.widths[rank] = len(data)

    def ids(self, text: str) -> list[int]:
        if _UNBROKEN.search(text):
            return self._steady.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


@lru_cache(2)
def encoder(path: str | None = None, ranks_path: str | None = None) -> Encoder:
    """The encoder of two files of one vocabulary, kept by the worker."""
    import public_tokenizers

    return Encoder(path or vocabulary(), ranks_path or vocabulary("tiktoken"), public_tokenizers.PATTERN)
