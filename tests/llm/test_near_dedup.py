import random
import re
from collections import defaultdict

import numpy as np
import pytest

from flowlab.llm.graph import connected_components
from flowlab.llm.near_dedup import band_shape, near_duplicates, signatures
from flowlab.llm.words import SPACED, Words, mix, shingle_set


def brute(rows, part, whole):
    """Components by comparing all pairs of word-shingle sets."""
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(words)} if 0 < len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)})
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and whole * both >= part * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append(key)
    least = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=repr)


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 30, 120]))
        for _ in range(rng.choice([1, 3, 12])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "one  TWO"), (905, "one two three"),
                   (3, rows[3][1]), (None, rows[5][1]), (None, "only here and nowhere else at all"), (906, "Ünï " * 50), (907, "ünï " * 50)]


@pytest.mark.parametrize("cell", [400_000, 300])
def test_against_all_pairs(spark, cell):
    rows = texts()
    docs = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], "doc_id long, text string, digest string, component int, n int")
    for part in (80, 85):
        made = near_duplicates(docs, part, 100, cell_shingles=cell).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in made), key=repr) == brute(rows, part, 100)
        assert all(r.kept == (r.doc_id == r.component_id) for r in made)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    import flowlab.llm.near_dedup as module

    monkeypatch.setattr(module, "TASK_CLASSES", 4)
    monkeypatch.setattr(module, "TASK_SHINGLES", 500)
    rows = texts()
    for cell in (200, 400_000):  # by bucket, and as whole cells
        made = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100, cell_shingles=cell).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in made), key=repr) == brute(rows, 80, 100)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = mix(np.arange(1, 2_001, dtype=np.uint64))
    for size, share in ((40, 0.5), (600, 0.8), (5, 0.6)):
        errors = []
        for _ in range(30):
            rng.shuffle(pool)
            both = round(size * 2 * share / (1 + share))
            one, two = pool[:size], pool[size - both:2 * size - both]
            made = signatures([np.sort(one), np.sort(two)], 180)
            errors.append((made[0] == made[1]).mean() - both / (2 * size - both))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_signature_is_the_same_in_any_company():
    sets = [np.unique(mix(np.arange(k, k + n, dtype=np.uint64))) for k, n in ((1, 3), (50, 700), (9, 90), (4, 4_000))]
    together = signatures(sets, 180)
    for one, row in zip(sets, together):
        assert (signatures([one], 180)[0] == row).all()


def test_band_shape():
    for share in (0.5, 0.8, 0.85, 1.0):
        bands, rows = band_shape(share)
        assert (1 - min(share, 1 - 1e-9) ** rows) ** bands <= 1.01e-6


def test_shingles_are_words_not_bytes():
    one, two = (shingle_set(Words([t], SPACED).hashes, 5) for t in (b"a b c d e f", b"ab c d e f g"))
    assert len(one) == len(two) == 2 and not set(one) & set(two)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 9), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (15, 16), (2, 1)]
    made = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in made} == {
        1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{k: 10 for k in range(10, 17)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_a_large_group_stay_linear(spark, monkeypatch):
    import flowlab.llm.near_dedup as module

    monkeypatch.setattr(module, "TASK_CLASSES", 20)
    calls = []

    def counted(edges, *args, **kwargs):
        calls.append(edges.count())
        return connected_components(edges, *args, **kwargs)

    monkeypatch.setattr(module, "connected_components", counted)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(300):
        words = list(base)
        words[(i * 7) % 300] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100).collect()
    assert {r["component_id"] for r in got} == {0}
    assert calls[-1] <= 300 + 15 * 14 // 2  # a forest inside blocks, at most one link a pair of blocks
