import math
import random
import re
from collections import Counter

import pytest

from flowlab.llm import lexical_search
from flowlab.llm.lexical_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items):
    """Every document scored for every item by the contract's formula."""
    bags = [Counter(terms(t)) for _, t in docs]
    big_n = sum(1 for b in bags if b)
    big_l = sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    queries = {}
    for item, text in items:
        queries.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in queries.items():
        scored = []
        for (doc_id, _), bag in zip(docs, bags):
            if not bag:
                continue
            n = sum(bag.values())
            m = 25 + (75 * n * big_n) // big_l
            s = 0
            for t, cnt in q.items():
                w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df.get(t, 0) + 1)))
                tf = bag.get(t, 0)
                s += cnt * w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((s, doc_id))
        scored.sort(key=lambda x: (-x[0], math.inf if x[1] is None else x[1]))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(scored[:10])]
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in search(d, b).collect()), key=repr)


def corpus(count=300, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)] + ["Über", "ÉTÉ", "x_y", "naïve"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(count)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))) for k in range(12)]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == brute(docs, items)


def test_small_blocks_and_saturated_signatures(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 7)
    monkeypatch.setattr(lexical_search, "BITS", 16)
    docs, items = corpus(120, 8)
    assert run(spark, docs, items) == brute(docs, items)


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = [(1, "alpha beta"), (2, "alpha beta"), (2, "alpha beta"), (None, "alpha beta"), (3, None), (4, ""),
            (5, "!!! ,,,"), (6, "gamma " * 50_000 + "alpha"), (7, "Alpha BETA delta")]
    items = [(1, "alpha"), (1, "beta"), (2, None), (None, "delta gamma"), (3, "zzz"), (4, "ALPHA")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    empty_docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(empty_docs, items).collect() == []
    docs = spark.createDataFrame([(1, "a b", 9, 9)], "doc_id long, text string, score long, rank int")
    wide = spark.createDataFrame([(1, "a", "x")], "item_id long, text string, term string")
    assert [tuple(r) for r in search(docs, wide).collect()] == [(1, 1, 1, brute([(1, "a b")], [(1, "a")])[0][3])]
    assert search(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", [11, 12])
def test_random_corpora(spark, seed):
    docs, items = corpus(200, seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_dealt_over_many_partitions_meet_their_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 20)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # no merging of shuffle partitions
    try:
        docs, items = corpus(200, 21)
        assert run(spark, docs, items) == brute(docs, items)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_ids_above_double_precision_beside_nulls(spark):
    big = 2**60
    docs = [(big + k, "alpha beta") for k in range(12, 0, -1)] + [(None, "alpha")]
    items = [(big + 1, "alpha"), (big + 2, "beta"), (None, "alpha beta")]
    assert run(spark, docs, items) == brute(docs, items)
