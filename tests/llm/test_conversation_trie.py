import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from flowlab.llm import conversation_trie as ct
from flowlab.llm.conversation_trie import ShardTrie, conversation_trie


def brute(rows):
    """Nodes of the trie of rebuilt conversations, by dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    for c, turns in own.items():
        mine = [(r, t) for _, _, r, t in sorted(turns)]
        base = [(r, t) for _, _, r, t in sorted(own.get(c - _rem(c), []))]
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = base[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    out = []
    for p, ms in members.items():
        sub = [q for q in members if q[:len(p)] == p]
        leaves = sum(1 for q in sub if kids[q] == 0)
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in sub)
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(seqs[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(ms), len(p), parent, len(ms), kids[p], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _rem(c):
    """c % 5 with the sign of c, as SQL and Spark compute it."""
    return int(abs(c) % 5) * (1 if c >= 0 else -1)


def run(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted((tuple(r) for r in conversation_trie(frame).collect()), key=repr)


def fixture(seed, convs=80):
    rng = random.Random(seed)
    texts = ["hi", "hello there", "Ünïcode ✓", "", None, "x" * 50, "same"]
    rows = []
    for c in range(convs):
        for turn in range(rng.randint(0, 6)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    for c in range(200, 240):  # one hot conversation copied many times
        rows += [(c, 0, "user", "the common start"), (c, 1, "assistant", "the common answer")]
    return rows


def test_brute_force_with_one_shard(spark):
    rows = fixture(1)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("shard_turns", [2, 7, 31])
def test_boundary_merging_over_many_shards(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(ct, "SHARD_TURNS", shard_turns)
    rows = fixture(2)
    assert run(spark, rows) == brute(rows)


def test_nulls_repeats_negatives_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ct, "SHARD_TURNS", 3)
    rows = [(None, 0, "user", "lost"), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, None, None, None),
            (-3, 1, "user", "neg"), (-8, 0, "user", "neg base"), (7, 0, "user", "t" * 100_000),
            (9, 0, None, "b"), (9, 0, "assistant", "b")]
    assert run(spark, rows) == brute(rows)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie(empty).collect() == []
    wide = spark.createDataFrame([(1, 0, "user", "a", 3, "x")],
                                 "conv_id long, turn long, role string, text string, depth long, key_a string")
    assert sorted(tuple(r) for r in conversation_trie(wide).collect()) == brute([(1, 0, "user", "a")])


def test_median_insertion_keeps_the_tree_shallow():
    trie = ShardTrie()
    seqs = sorted([[(i, 0)] for i in range(1023)])
    stack = [(0, len(seqs))]
    while stack:
        lo, hi = stack.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            trie.insert(seqs[mid], mid)
            stack += [(lo, mid), (mid + 1, hi)]
    depth, cur, seen = 0, [trie.top], 0
    while cur:
        seen += len(cur)
        cur = [x for u in cur for x in (trie.lo[u], trie.hi[u]) if x != -1]
        depth += 1
    assert seen == 1023 and depth == 10
