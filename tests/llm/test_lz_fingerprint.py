import hashlib
import random
import re

import numpy as np

from flowlab.llm.lz_fingerprint import EMPTY, SLOTS, fingerprint_texts, phrase_hashes, signature
from flowlab.llm.words import _hashes


def lz78(data: bytes) -> list[bytes]:
    """The LZ78 phrases of ``data`` over word symbols, by the textbook loop."""
    words = re.findall(rb"\s*\S+\s*|\s+", data)
    seen, out, i = set(), [], 0
    while i < len(words):
        j = i + 1
        while j <= len(words) and tuple(words[i:j]) in seen:
            j += 1
        if j > len(words):
            break  # an unfinished tail repeats a known phrase
        seen.add(tuple(words[i:j]))
        out.append(b"".join(words[i:j]))
        i = j
    return out


def content_hash(phrase: bytes) -> int:
    data = np.frombuffer(phrase, dtype=np.uint8)
    return int(_hashes(data, np.array([0]), np.array([len(phrase)]))[0])


def alike(a: str, b: str) -> float:
    return sum(a[i:i + 4] == b[i:i + 4] for i in range(0, 4 * SLOTS, 4)) / SLOTS


def brute(rows):
    """Edits, digests and likeness by plain loops over the descending doc_id order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))  # ties by text
    out = []
    for k, (doc_id, text) in enumerate(order):
        text = text or ""
        following = order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        mine, theirs = signature(text.encode()), signature(following.encode())
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mine,
                    signature(edited.encode()), alike(mine, signature(edited.encode())), alike(mine, theirs)))
    return sorted(out, key=repr)


def run(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in fingerprint_texts(frame).collect()), key=repr)


def test_phrases_are_the_lz78_parse():
    rng = random.Random(1)
    for _ in range(50):
        data = bytes(rng.choice(b"ab  \n") for _ in range(rng.randint(0, 300)))
        want = np.unique(np.array([content_hash(p) for p in lz78(data)], dtype=np.uint64))
        assert np.array_equal(phrase_hashes(data), want)


def test_signature_properties():
    text = ("the quick brown fox jumps over the lazy dog " * 40).encode()
    assert signature(text) == signature(bytes(text))
    assert signature(b"") == EMPTY
    assert alike(signature(b""), signature(b"")) == 1.0
    assert alike(signature(b""), signature(b"x")) == 0.0
    other = ("a wholly different passage about rivers and hills " * 40).encode()
    assert alike(signature(text), signature(text[:-50] + b"tail")) > alike(signature(text), signature(other))


def test_matches_plain_loops(spark):
    rng = random.Random(4)
    words = ["Étoile", "über", "🙂x", "river", "stone", "a", "the"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(None, "no id"), (None, None), (7, "same id"), (7, "same id"), (61, ""), (62, None)]
    assert run(spark, rows) == brute(rows)


def test_long_texts_single_rows_and_empty(spark):
    rows = [(1, "x" * 200_000 + "é" * 3), (2, "short")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(5, "alone here")]) == brute([(5, "alone here")])
    assert run(spark, []) == []


def test_extra_columns_are_ignored(spark):
    frame = spark.createDataFrame([(1, "ab", "c", 3.0)], "doc_id long, text string, fingerprint string, near_next double")
    assert sorted(tuple(r) for r in fingerprint_texts(frame).collect()) == brute([(1, "ab")])


def test_pairs_across_many_blocks(spark, monkeypatch):
    from flowlab.llm import lz_fingerprint

    monkeypatch.setattr(lz_fingerprint, "BLOCK_ROWS", 3)
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(12)]), rng.choice(["", None, "ab", "river stone " * rng.randint(1, 30)]))
            for _ in range(40)]
    assert run(spark, rows) == brute(rows)
