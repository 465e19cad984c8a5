"""Words, word hashes and shingle hashes of whole texts, in numpy blocks.

A block of texts is joined to one byte string, A-Z are lower-cased, and every
word gets its byte span and a 64-bit hash.  All work is per byte or per word in
numpy; nothing depends on how texts are dealt over blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

BLOCK_BYTES = 4 << 20
TEXT_ROWS = 1_000
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_ONES = (1 << 64) - 1

SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python ``TEXT_ROWS`` rows at a time, so a batch of long rows stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)


def blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of encoded texts of about ``limit`` bytes, with the index of their first text."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if held and size + len(data) > limit:
            yield first, held
            first, size, held = i, 0, []
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(_CHUNK + 1, _BASE, dtype=np.uint64)
    down = np.full(_CHUNK + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span, in chunks so that temporary arrays stay small."""
    up, down = _powers()
    out = np.empty(len(starts), dtype=np.uint64)
    lengths = ends - starts
    for i in np.flatnonzero(lengths > _CHUNK):
        span = data[starts[i]:ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little")
    i = 0
    while i < len(starts):
        if lengths[i] > _CHUNK:
            i += 1
            continue
        base = starts[i]
        j = i + int(np.searchsorted(ends[i:], base + _CHUNK, side="right"))
        total = np.zeros(int(ends[j - 1] - base) + 1, dtype=np.uint64)
        np.cumsum(data[base:ends[j - 1]] * up[:len(total) - 1], out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * down[a] + lengths[i:j].astype(np.uint64))
        i = j
    return out


class Words:
    """Words of a block: byte spans, hashes, and the first word of each text."""

    def __init__(self, texts: list[bytes], inside: np.ndarray, hashed: bool = True):
        self.blob = (b"\n".join(texts) + b"\n").lower()
        data = np.frombuffer(self.blob, dtype=np.uint8)
        marks = inside[data].view(np.int8)
        step = np.diff(marks, prepend=np.int8(0))
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, begins)
        self.counts = np.diff(self.first)
        self.hashes = _hashes(data, self.starts, self.ends) if hashed else None

    def text(self, i: int, j: int) -> list[bytes]:
        """The words from ``i`` up to ``j``."""
        return [self.blob[a:b] for a, b in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist())]


@lru_cache(8)
def _weights(size: int) -> tuple[np.uint64, ...]:
    return tuple(np.uint64((_BASE * (2 * k + 3) ** 5 | 1) & _ONES) for k in range(size))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k, weight in enumerate(_weights(size)):
        out += hashes[k:k + n] * weight
    return mix(out)


def run_rows(hashes: np.ndarray) -> np.ndarray:
    """The hash ``runs`` gives, for runs that are rows of a matrix."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for k, weight in enumerate(_weights(hashes.shape[1])):
        out += hashes[:, k] * weight
    return mix(out)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; a shorter text is one shingle."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    if len(hashes) < size:
        whole = runs(hashes, len(hashes)) + np.uint64(len(hashes))
        return mix(whole)
    return np.unique(runs(hashes, size))
