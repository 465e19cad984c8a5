import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlab.llm.packing import best_multiset, pack_sequences, plan_windows
from flowlab.llm.tokens import encoder, vocabulary

SCHEMA = "doc_id long, text string, length int, crc string"


def tokens(text, end=1):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary())
    made.encode_special_tokens = True
    return np.array([*made.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def verify(texts, rows, capacity):
    """Pieces cover each document once and lie gapless in full or power-of-two sequences."""
    left = defaultdict(list)
    for r in rows:
        left[r.doc_id].append(r)
    spaces = defaultdict(list)
    for r in rows:
        spaces[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for key, text in texts:
        expected[key].append(tokens(text))
    for key, copies in expected.items():
        covered = np.zeros(max(map(len, copies)), dtype=int)
        for r in left.pop(key):
            assert any(len(c) == r.doc_tokens and zlib.crc32(c[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                       for c in copies)
            covered[r.start:r.start + r.length] += 1
        wanted = np.zeros_like(covered)
        for c in copies:
            wanted[:len(c)] += 1
        assert (covered == wanted).all()
    assert not left
    for places in spaces.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity


@pytest.mark.parametrize("capacity", [8, 64, 2048])
def test_pack(spark, capacity):
    texts = [(k, "the quick brown fox " * (k % 37)) for k in range(150)] + [
        (200, None), (201, ""), (None, "no id here"), (None, "another text without id"), (5, "the quick brown fox " * 5),
        (300, "x" * 5_000), (301, "déjà vu <|endoftext|> ok"), (302, "a b\n" * 3_000)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts], SCHEMA)
    verify(texts, pack_sequences(docs, capacity).collect(), capacity)


def test_pack_empty_table(spark):
    assert pack_sequences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_encoders_agree():
    for text in ("", "Hello, world!  two  spaces\n\n", "naïve café 漢字 🙂🙂", "a" * 1_999, "ab " * 999, "<|endoftext|>"):
        assert [*encoder().ids(text), 1] == tokens(text).tolist()


@given(st.dictionaries(st.integers(1, 31), st.integers(1, 40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_token_once(counts):
    placed, filled = defaultdict(int), defaultdict(int)
    for whole, cut, size, low, high, first, _ in plan_windows(counts, 32):
        for rank in range(low, high):
            for at in range(cut, cut + size):
                placed[whole, rank, at] += 1
            filled[first + rank - low] += size
    assert placed == {(n, r, k): 1 for n, c in counts.items() for r in range(c) for k in range(n)}
    assert all(f == 32 or f & (f - 1) == 0 and f < 32 for f in filled.values())
    assert sum(f < 32 for f in filled.values()) <= 5


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=6), st.integers(0, 40))
@settings(max_examples=100, deadline=None)
def test_best_multiset(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    used = best_multiset(counts, room)
    assert sum(n * c for n, c in used.items()) == max(sums) and all(c <= counts[n] for n, c in used.items())
