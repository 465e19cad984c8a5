"""Ranked lexical search through bit-sliced Bloom signatures, rescored exactly.

Every document gets a Bloom signature of ``BITS`` bits over its distinct terms.
Documents are dealt by hash into blocks of about ``BLOCK_DOCS``; inside a block the
signatures are stored bit-sliced: slice ``j`` is the bitmap, one bit per document,
of the documents whose signature has bit ``j`` set.  A query term's ``HASHES`` slices
ANDed give the documents that may hold it (a superset).  Summing, for each query
term, its weight times the slice result gives every document an upper bound of its
score.  Documents are then scored exactly in falling order of that bound until the
bound drops below the tenth best exact score of the block; those left are provably
out.  The ten best of every block are merged into the ten best of all.

Scoring (fixed by the contract): terms are maximal runs of the characters outside
ASCII punctuation, space and control codes, with only A-Z lower-cased; ``N`` counts
documents with at least one term, ``L`` sums their term counts, a term's weight is
``floor(1000 * ln((2N + 2) / (2 df + 1)))`` and a document's score for an item is
``sum(w * ((1e9 * tf) div (1000 * tf + 8 * m)))`` over the item's terms, repeats
included, with ``m = 25 + (75 * n * N) div L`` in 64-bit integers.

Edge cases: a null or termless text is a document with no terms (it counts in no
statistic and never scores); a null or termless item has no results.  Rows that
share an item id are one item whose terms are those of all its rows.  Every
document row is a document of its own, repeated rows included; equal scores go to
the smaller doc_id, a null doc_id last.  Very long texts are read whole.  Columns
other than ``doc_id``/``text`` and ``item_id``/``text`` are ignored.
"""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.scratch import materialize

# fixed values of the contract: the term pattern and the score constants
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
TOP = 10

BITS = 1 << 13
HASHES = 3
BLOCK_DOCS = 1024

RESULT = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("score", T.LongType()),
])


def terms_of(text: F.Column) -> F.Column:
    """The terms of a text in order, repeats included; none for null."""
    pieces = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(pieces, lambda t: t != "")


def tf_part(tf: np.ndarray | int, m: np.ndarray | int):
    """The contract's saturated term frequency, in 64-bit integers."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _positions(hashes: np.ndarray) -> np.ndarray:
    """``HASHES`` bit positions of each 64-bit term hash, by double hashing."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((low[:, None] + steps[None, :] * high[:, None]) % np.uint64(BITS)).astype(np.int64)


def _hash(terms: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(terms.astype(object), categorize=False)


def _block_search(docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The exact ten best documents of one block for every item."""
    if docs.empty or queries.empty:
        return _rows([])
    count = len(docs)
    # ids stay integers beside their null marks: a column with nulls would come as doubles
    doc_ids = [None if gone else i for i, gone in zip(docs["doc_id"].tolist(), docs["no_id"].tolist())]
    m = docs["m"].to_numpy(dtype=np.int64)
    n = docs["n"].to_numpy(dtype=np.int64)
    lists = docs["terms"].tolist()
    owner = np.repeat(np.arange(count), [len(t) for t in lists])
    terms = np.concatenate([np.asarray(t, dtype=object) for t in lists]) if len(owner) else np.empty(0, object)
    hashes = _hash(terms)
    # bit slices: slice j holds one bit per document of the block
    bits = np.zeros((BITS, count), dtype=bool)
    where = _positions(hashes)
    for k in range(HASHES):
        bits[where[:, k], owner] = True
    slices = np.packbits(bits, axis=1)
    del bits, where
    # exact counts of the query terms, for rescoring only
    wanted = np.isin(hashes, _hash(queries["term"].to_numpy()))
    held = pd.DataFrame({"doc": owner[wanted], "term": terms[wanted]}).value_counts()
    tf = dict(zip(held.index.tolist(), held.tolist()))
    best_part = tf_part(n, m)  # largest saturated frequency a document can reach
    maybe_of: dict[str, np.ndarray] = {}
    out = []
    for (item, gone), found in queries.groupby(["item_id", "no_item"], sort=False):
        item = None if gone else int(item)
        bound = np.zeros(count, dtype=np.int64)
        plan = []
        for term, cnt, w in zip(found["term"], found["cnt"], found["w"]):
            if w <= 0:
                continue
            plan.append((term, int(cnt) * int(w)))
            if term not in maybe_of:
                p = _positions(_hash(np.array([term], dtype=object)))[0]
                hit = slices[p[0]]
                for j in p[1:]:
                    hit = hit & slices[j]
                maybe_of[term] = np.unpackbits(hit, count=count).astype(bool)
            bound += np.where(maybe_of[term], int(cnt) * int(w), 0)
        bound = bound * best_part
        order = np.lexsort((np.arange(count), -bound))
        top: list[tuple[int, tuple[bool, int], int]] = []  # (score, larger for smaller ids, index): a min-heap of the best
        for i in order.tolist():
            if bound[i] <= 0 or (len(top) == TOP and bound[i] < top[0][0]):
                break
            score = 0
            for term, weight in plan:
                f = tf.get((i, term))
                if f:
                    score += weight * int(tf_part(f, int(m[i])))
            if score <= 0:
                continue
            key = (score, _desc(doc_ids[i]), i)
            if len(top) < TOP:
                heapq.heappush(top, key)
            elif key > top[0]:
                heapq.heapreplace(top, key)
        out.extend((item, doc_ids[i], s) for s, _, i in top)
    return _rows(out)


def _rows(out: list[tuple]) -> pd.DataFrame:
    """Result rows with nullable 64-bit ids."""
    return pd.DataFrame({
        "item_id": pd.array([r[0] for r in out], dtype="Int64"), "doc_id": pd.array([r[1] for r in out], dtype="Int64"),
        "score": pd.Series([r[2] for r in out], dtype="int64")})


def _desc(doc_id: int | None) -> tuple[bool, int]:
    """Larger for smaller ids, so that a min-heap drops the larger id of a tie; null smallest."""
    return (False, 0) if doc_id is None else (True, -doc_id)


def search(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each item's ten best documents: item_id, rank (int, from 1), doc_id, score (long)."""
    spark = documents.sparkSession
    docs = materialize(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), terms_of(F.col("text")).alias("terms")
    ).withColumn("_row", F.monotonically_increasing_id()).withColumn("n", F.size("terms").cast("long"))
        .where("n > 0"), "search-docs")
    stats = docs.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    big_n, big_l = int(stats["N"] or 0), int(stats["L"] or 0)
    if big_n == 0:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = max(1, -(-big_n // BLOCK_DOCS))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("term"))
    items = items.groupBy("item_id", "term").agg(F.count("*").alias("cnt"))
    vocabulary = materialize(items.select("term").distinct(), "search-vocabulary")
    df = (docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(vocabulary, "term", "left_semi")
          .groupBy("term").agg(F.count("*").alias("df")))
    weights = items.join(df, "term", "left").select(
        "item_id", "term", "cnt",
        F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * big_n + 2)) / (F.lit(2.0) * F.coalesce("df", F.lit(0)) + 1))).alias("w"))
    # both sides number blocks by ints: an int and a long of one value hash to different partitions
    queries = materialize(weights, "search-queries").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.coalesce("item_id", F.lit(0)).alias("item_id"), F.col("item_id").isNull().alias("no_item"), "term", "cnt", "w")
    m = F.lit(25) + F.expr(f"(75 * n * {big_n}L) div {big_l}L")
    doc_side = docs.select(F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("block"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
                           F.col("doc_id").isNull().alias("no_id"), "n", m.alias("m"), "terms")
    found = doc_side.groupBy("block").cogroup(queries.groupBy("block")).applyInPandas(_block_search, RESULT)
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).cast("int"))
    return ranked.where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")
