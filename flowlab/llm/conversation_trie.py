"""Prefix trie of conversations: ternary search trees per range shard, merged at shard boundaries.

Turns are dictionary-encoded: a turn's id is the 64-bit hash of (role, text) with
the rank among the rare distinct turns that share a hash, so ids are exact.
Conversations become sequences of ids, are range-partitioned by (sequence, conv_id)
into shards of about ``SHARD_TURNS`` turns, and each shard builds a ternary search
tree over its sorted sequences, inserting medians first so that the tree stays
balanced.  A trie node is a tree node reached by an ``eq`` edge; since a child is
always made after its parent, one pass over the nodes in reverse order of making
them accumulates members, smallest member, children, leaves and saved bytes from
children into parents without recursion.

A trie node's members are a contiguous run of the sorted sequences, so only nodes
on the path of a shard's first or last sequence can lie in several shards.  Node
rows of all shards are merged by a 128-bit key of their prefix; what the shards
counted twice is taken off along the common path of each pair of neighbouring
shards (its nodes' children, leaves and distinct bytes), one row per path node.
Member lists for the ``ends_sha256`` digest of such nodes are hashed in conv_id
order by a sorted, streaming pass.

Contract of the rebuild (fixed): turns are ordered by turn (null first), then role
and text; a null role or text is empty.  Conversation ``c`` takes the first
``h = crc32(decimal c) % 9`` turns of conversation ``c - c % 5`` (all if fewer, none
if it is absent), then its own turns after its first ``h``.

Edge cases: rows with a null conv_id belong to no conversation and are left out;
repeated rows are repeated turns; a conversation that ends up without turns is a
member of the root only; an empty table gives no nodes.  Very long texts only
enter through their hash and byte count.  Columns other than conv_id, turn, role
and text are ignored.  A single conversation's turn ids must fit one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.scratch import materialize

SHARD_TURNS = 200_000
HOPS = 9
BASE_STEP = 5

_M = (1 << 64) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()
SHARD_ROWS = (
    "kind string, shard int, key_a long, key_b long, depth long, parent_a long, parent_b long, b long, "
    "n long, mn long, c long, ls long, s long, digest string, conv_id long, "
    "path_a array<long>, path_b array<long>, path_bytes array<long>"
)
RESULT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string")


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _M
    return x ^ (x >> 31)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _step(key: tuple[int, int], turn: tuple[int, int]) -> tuple[int, int]:
    """The prefix key of a child: two independent 64-bit chains over the turn ids."""
    x = (turn[0] * 0x9E3779B97F4A7C15 + turn[1] + 1) & _M
    return _mix((key[0] * 0x100000001B3) & _M ^ x), _mix((key[1] + x * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & _M)


class ShardTrie:
    """A ternary search tree over the sorted id sequences of one shard."""

    def __init__(self):
        self.split: list[tuple[int, int]] = []
        self.lo: list[int] = []
        self.eq: list[int] = []
        self.hi: list[int] = []
        self.up: list[int] = []  # trie parent: the node whose eq subtree holds this one, -1 for the root
        self.depth: list[int] = []
        self.key: list[tuple[int, int]] = []
        self.ends: list[list[int]] = []
        self.top = -1
        self.root_ends: list[int] = []

    def _make(self, turn, up, depth, key) -> int:
        self.split.append(turn)
        for field in (self.lo, self.eq, self.hi):
            field.append(-1)
        self.up.append(up)
        self.depth.append(depth)
        self.key.append(key)
        self.ends.append([])
        return len(self.split) - 1

    def insert(self, seq: list[tuple[int, int]], member: int) -> None:
        if not seq:
            self.root_ends.append(member)
            return
        field, owner = None, -1  # where the current node hangs
        cur, d, up, key = self.top, 0, -1, (0, 0)
        while True:
            turn = seq[d]
            if cur == -1:
                cur = self._make(turn, up, d + 1, _step(key, turn))
                if field is None:
                    self.top = cur
                else:
                    field[owner] = cur
            here = self.split[cur]
            if turn < here:
                field, owner, cur = self.lo, cur, self.lo[cur]
            elif turn > here:
                field, owner, cur = self.hi, cur, self.hi[cur]
            elif d == len(seq) - 1:
                self.ends[cur].append(member)
                return
            else:
                d, up, key = d + 1, cur, self.key[cur]
                field, owner, cur = self.eq, cur, self.eq[cur]

    def path(self, seq: list[tuple[int, int]]) -> list[int]:
        """Tree nodes of the prefixes of a sequence that was inserted, depth 1 onwards."""
        out, cur = [], self.top
        for turn in seq:
            while turn != self.split[cur]:
                cur = self.lo[cur] if turn < self.split[cur] else self.hi[cur]
            out.append(cur)
            cur = self.eq[cur]
        return out


def _digest(members: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(members))).encode()).hexdigest()


def _shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shard = TaskContext.get().partitionId()
    members, seqs, sizes = [], [], []
    for batch in batches:
        for c, hs, ks, bs in zip(batch["conv_id"], batch["hs"], batch["ks"], batch["bs"]):
            members.append(int(c))
            seqs.append(list(zip(hs.tolist(), ks.tolist())))
            sizes.append(bs.tolist())
    if not members:
        return
    order = sorted(range(len(members)), key=lambda i: (seqs[i], members[i]))
    trie = ShardTrie()
    byte_of: dict[tuple[int, int], int] = {}
    for i in range(len(members)):
        byte_of.update(zip(seqs[i], sizes[i]))
    stack = [(0, len(order))]
    while stack:  # medians first: every subtree's top is the median of its range
        lo, hi = stack.pop()
        if lo >= hi:
            continue
        mid = (lo + hi) // 2
        trie.insert(seqs[order[mid]], members[order[mid]])
        stack += [(lo, mid), (mid + 1, hi)]
    first, last = seqs[order[0]], seqs[order[-1]]
    on_path = set(trie.path(first)) | set(trie.path(last))
    count = len(trie.split)
    n = [len(e) for e in trie.ends]
    mn = [min(e) if e else None for e in trie.ends]
    kids = [0] * count
    leaves = [0] * count
    saved = [0] * count
    b = [byte_of[t] for t in trie.split]
    root = {"n": len(trie.root_ends), "mn": min(trie.root_ends) if trie.root_ends else None, "c": 0, "ls": 0, "s": 0}
    for u in range(count - 1, -1, -1):  # children are always made after their parent
        leaves[u] += kids[u] == 0
        saved[u] += (n[u] - 1) * b[u]
        p = trie.up[u]
        if p == -1:
            root["n"] += n[u]
            root["mn"] = mn[u] if root["mn"] is None else min(root["mn"], mn[u])
            root["c"] += 1
            root["ls"] += leaves[u]
            root["s"] += saved[u]
        else:
            n[p] += n[u]
            mn[p] = mn[u] if mn[p] is None else min(mn[p], mn[u])
            kids[p] += 1
            leaves[p] += leaves[u]
            saved[p] += saved[u]
    root["ls"] += root["c"] == 0
    rows = [{"kind": "n", "key_a": 0, "key_b": 0, "depth": 0, "parent_a": None, "parent_b": None, "b": 0, **root,
             "digest": None}]
    rows += [{"kind": "e", "key_a": 0, "key_b": 0, "conv_id": m} for m in trie.root_ends]
    for u in range(count):
        up = trie.up[u]
        parent = (0, 0) if up == -1 else trie.key[up]
        rows.append({"kind": "n", "key_a": _signed(trie.key[u][0]), "key_b": _signed(trie.key[u][1]),
                     "depth": trie.depth[u], "parent_a": _signed(parent[0]), "parent_b": _signed(parent[1]),
                     "b": b[u], "n": n[u], "mn": mn[u], "c": kids[u], "ls": leaves[u], "s": saved[u],
                     "digest": None if u in on_path else (_digest(trie.ends[u]) if trie.ends[u] else _EMPTY)})
        if u in on_path:
            rows += [{"kind": "e", "key_a": _signed(trie.key[u][0]), "key_b": _signed(trie.key[u][1]), "conv_id": m}
                     for m in trie.ends[u]]
    for which, seq in (("first", first), ("last", last)):
        nodes = trie.path(seq)
        rows.append({"kind": which, "path_a": [0] + [_signed(trie.key[u][0]) for u in nodes],
                     "path_b": [0] + [_signed(trie.key[u][1]) for u in nodes],
                     "path_bytes": [0] + [b[u] for u in nodes]})
    frame = pd.DataFrame(rows, dtype=object).reindex(columns=[f.split(" ")[0] for f in SHARD_ROWS.split(", ")])
    frame["shard"] = shard
    for name, kind in (f.split(" ") for f in SHARD_ROWS.split(", ")):
        if kind == "long":
            frame[name] = frame[name].astype("Int64")
        elif name != "shard":
            frame[name] = [v if isinstance(v, (list, str)) else None for v in frame[name]]
    yield frame


def _common_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each pair of neighbouring shards, the nodes both hold and what they counted twice."""
    for batch in batches:
        out = []
        for la, lb, fa, fb, fbytes in zip(batch["last_a"], batch["last_b"], batch["first_a"], batch["first_b"],
                                          batch["first_bytes"]):
            deep = 0
            while deep + 1 < min(len(la), len(fa)) and la[deep + 1] == fa[deep + 1] and lb[deep + 1] == fb[deep + 1]:
                deep += 1
            tail = np.cumsum(np.asarray(fbytes[:deep + 1], dtype=np.int64)[::-1])[::-1]
            for d in range(deep + 1):
                out.append((int(fa[d]), int(fb[d]), int(tail[d]), int(d < deep), int(fa[deep]), int(fb[deep])))
        yield pd.DataFrame(out, columns=["key_a", "key_b", "q", "k", "deep_a", "deep_b"])


def _stream_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of sorted member lists, carried across batches of a partition."""
    current, hasher, started = None, None, False
    for batch in batches:
        out = []
        for a, b, c in zip(batch["key_a"].tolist(), batch["key_b"].tolist(), batch["conv_id"].tolist()):
            if (a, b) != current:
                if current is not None:
                    out.append((*current, hasher.hexdigest()))
                current, hasher, started = (a, b), hashlib.sha256(), False
            hasher.update((b"," if started else b"") + str(c).encode())
            started = True
        yield pd.DataFrame(out, columns=["key_a", "key_b", "ends"])
    if current is not None:
        yield pd.DataFrame([(*current, hasher.hexdigest())], columns=["key_a", "key_b", "ends"])


def rebuilt_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and its rebuilt turns as parallel arrays of id hashes, id ranks and text bytes."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = turns.select("role", "text").distinct().withColumn("h", F.xxhash64("role", "text"))
    shared = materialize(pairs.groupBy("h").count().where("count > 1").select("h"), "trie-collisions")
    ranked = pairs.join(shared, "h", "left_semi").withColumn(
        "k", F.dense_rank().over(Window.partitionBy("h").orderBy("role", "text")) - 1)
    coded = turns.withColumn("h", F.xxhash64("role", "text")).join(
        materialize(ranked.select("h", "role", "text", "k"), "trie-ranks"), ["h", "role", "text"], "left")
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    coded = coded.select("conv_id", F.row_number().over(place).alias("i"), "h",
                         F.coalesce("k", F.lit(0)).cast("int").alias("k"), F.octet_length("text").cast("long").alias("b"))
    own = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "h", "k", "b"))).alias("t"))
    own = materialize(own, "trie-own")
    base = own.select(F.col("conv_id").alias("base_id"), F.col("t").alias("base_t"))
    hop = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HOPS).cast("int")
    joined = own.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % BASE_STEP).withColumn("hop", hop).join(
        base, "base_id", "left")
    t = F.concat(F.filter(F.coalesce("base_t", F.array().cast("array<struct<i:int,h:long,k:int,b:long>>")),
                          lambda x, i: i < F.col("hop")),
                 F.filter("t", lambda x, i: i >= F.col("hop")))
    return joined.select("conv_id", t.alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["h"].alias("h"), x["k"].alias("k"))).alias("seq"),
        F.col("t.b").alias("bs"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per trie node; see ``RESULT`` and the module text."""
    spark = conversations.sparkSession
    seqs = materialize(rebuilt_sequences(conversations), "trie-seqs")
    total = seqs.select(F.sum(F.size("seq") + 1).alias("t")).first()["t"]
    if not total:
        return spark.createDataFrame([], RESULT)
    shards = max(1, -(-int(total) // SHARD_TURNS))
    ranged = seqs.repartitionByRange(shards, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    shard_out = materialize(ranged.select("conv_id", F.col("seq.h").alias("hs"), F.col("seq.k").alias("ks"), "bs")
                            .mapInPandas(_shard, SHARD_ROWS), "trie-shards")
    nodes = shard_out.where("kind = 'n'").groupBy("key_a", "key_b").agg(
        F.first("depth").alias("depth"), F.first("parent_a").alias("parent_a"), F.first("parent_b").alias("parent_b"),
        F.sum("n").alias("n"), F.min("mn").alias("conv_id"), F.sum("c").alias("c"), F.sum("ls").alias("ls"),
        F.sum("s").alias("s"), F.sum((F.col("c") == 0).cast("long")).alias("leafy"), F.max("c").alias("most_c"),
        F.max("digest").alias("digest"), F.count("*").alias("copies"))
    # neighbouring non-empty shards and the path they share
    firsts = shard_out.where("kind = 'first'").select("shard", F.col("path_a").alias("first_a"),
                                                      F.col("path_b").alias("first_b"),
                                                      F.col("path_bytes").alias("first_bytes"))
    lasts = shard_out.where("kind = 'last'").select(F.col("shard").alias("prev"), F.col("path_a").alias("last_a"),
                                                    F.col("path_b").alias("last_b"))
    # one row per shard: bounded by the shard count
    prev = firsts.select("shard").withColumn("prev", F.lag("shard").over(Window.orderBy("shard")))
    pairs = prev.where("prev is not null").join(firsts, "shard").join(lasts, "prev")
    common = materialize(pairs.mapInPandas(
        _common_paths, "key_a long, key_b long, q long, k long, deep_a long, deep_b long"), "trie-common")
    twice = common.groupBy("key_a", "key_b").agg(F.sum("q").alias("q"), F.sum("k").alias("k"))
    f = nodes.select(F.col("key_a").alias("deep_a"), F.col("key_b").alias("deep_b"),
                     (F.col("leafy") - (F.col("most_c") == 0).cast("long")).alias("f")).where("f != 0")
    leaf_fix = common.select("key_a", "key_b", "deep_a", "deep_b").distinct().join(f, ["deep_a", "deep_b"]).groupBy(
        "key_a", "key_b").agg(F.sum("f").alias("lf"))
    ends = (shard_out.where("kind = 'e'").select("key_a", "key_b", "conv_id")
            .repartition("key_a", "key_b").sortWithinPartitions("key_a", "key_b", "conv_id")
            .mapInPandas(_stream_digests, "key_a long, key_b long, ends string"))
    fixed = (nodes.join(twice, ["key_a", "key_b"], "left").join(leaf_fix, ["key_a", "key_b"], "left")
             .join(ends, ["key_a", "key_b"], "left"))
    fixed = materialize(fixed.select(
        "key_a", "key_b", "parent_a", "parent_b", "conv_id", "depth", F.col("n").alias("n_convs"),
        (F.col("c") - F.coalesce("k", F.lit(0))).alias("n_children"),
        (F.col("ls") - F.coalesce("lf", F.lit(0))).alias("n_leaves"),
        (F.col("s") + F.coalesce("q", F.lit(0))).alias("saved_tokens"),
        F.coalesce("digest", "ends", F.lit(_EMPTY)).alias("ends_sha256")), "trie-nodes")
    parents = fixed.select(F.col("key_a").alias("parent_a"), F.col("key_b").alias("parent_b"),
                           F.col("conv_id").alias("parent_conv_id"))
    return fixed.join(parents, ["parent_a", "parent_b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
