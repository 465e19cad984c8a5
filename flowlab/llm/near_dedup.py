"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Every element of a document's shingle set draws one random permutation of the
signature's places and visits them in that order, its j-th visit offering a
value between j and j + 1; a place keeps its least offer.  Places are thus filled
by different elements, which lowers the variance, and visits stop as soon as no
place can improve.

Documents with equal sets form one class, and all further work is on classes.
Classes that share a band of the signature are candidates; candidates joined
through shared bands form a cell.  The full sets of a cell meet in a task, which
counts the intersections of all its pairs and unites linked classes; a cell of
several blocks has a task for every block and then for every pair of blocks, where
classes that their own blocks already linked start united, so a pair of blocks
sends only links between components left apart.  A cell too large to compare
as a whole is taken apart by bucket, so that every candidate pair still meets in
some task.  Tasks emit spanning links only; components of these links are the
groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.llm.graph import connected_components
from flowlab.llm.words import SPACED, Words, blocks, mix, shingle_set, small_batches
from flowlab.scratch import materialize

SHINGLE = 5
MISS = 1e-6
PLACES = 180
CELL_SHINGLES = 400_000
CELL_CLASSES = 4_000
TASK_SHINGLES = 100_000
TASK_CLASSES = 1_000


def band_shape(share: float, miss: float = MISS, places: int = PLACES) -> tuple[int, int]:
    """Bands and rows: the longest bands that miss a pair at the threshold with
    probability ``miss`` at most, within ``places``; bands of one row otherwise."""
    best = (max(1, math.ceil(math.log(miss) / math.log1p(-min(share, 1 - 1e-9)))), 1)
    for rows in range(2, places + 1):
        hit = min(share, 1 - 1e-9) ** rows
        bands = math.ceil(math.log(miss) / math.log1p(-hit))
        if bands * rows <= places:
            best = (bands, rows)
    return best


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets: a row of ``places`` numbers each.

    A value is 2^32 times the visit's number plus 32 random bits.
    """
    out = np.full((len(sets), places), np.iinfo(np.uint64).max, dtype=np.uint64)
    if not sets:
        return out
    elements, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order: np.ndarray | None = None
    flat = out.reshape(-1)
    for visit in range(places):
        drawn = mix(elements + np.uint64((visit + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        value = (drawn >> np.uint64(32)) | np.uint64(visit << 32)
        swap = visit + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(places - visit) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = swap
        else:
            rows = np.arange(len(elements))
            place = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[:, visit]
        np.minimum.at(flat, doc * places + place, value)
        open_docs = out.max(axis=1) >= np.uint64((visit + 1) << 32)
        going = open_docs[doc]
        if not going.any():
            break
        if order is None:
            elements, doc, swap = elements[going], doc[going], swap[going]
            order = np.tile(np.arange(places, dtype=np.uint16), (len(elements), 1))
            order[np.arange(len(elements)), swap] = 0
        elif going.mean() < 0.7:
            elements, doc, order = elements[going], doc[going], order[going]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for row in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, row:bands * rows:rows])
    return keys.view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    words = Words(texts, SPACED)
    return [shingle_set(words.hashes[a:b], size) for a, b in zip(words.first[:-1], words.first[1:])]


def _features(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column("text").to_pylist(), 1 << 20):
                sets = _sets(texts, size)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), bands), dtype=np.int64)
                if full:
                    keys[full] = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                     *(pa.array(keys[:, k]) for k in range(bands))],
                    names=["doc_id", "text_key", "n_shingles", "digest", *(f"band{k}" for k in range(bands))])

    return run


def _wanted_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("digest").to_pylist()
            for first, texts in blocks(batch.column("text").to_pylist(), 1 << 20):
                sets = _sets(texts, size)
                right = [i for i, s in enumerate(sets) if len(s) and digest(s) == wanted[first + i]]
                if right:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("class").take(pa.array([first + i for i in right])),
                         pa.array([sets[i].tobytes() for i in right], pa.binary())], names=["class", "shingles"])

    return run


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, part: int, whole: int):
    """Pairs (i, j) with whole * intersection >= part * union; all pairs i < j if ``right`` is None.

    Elements become dense numbers; marking one set and adding up the marks under
    all others gives its intersections with every one of them.
    """
    others = left if right is None else right
    sizes = np.array([len(s) for s in others])
    stack = np.concatenate([*left, *others])
    _, number = np.unique(stack, return_inverse=True)
    own, theirs = number[:sum(map(len, left))], number[sum(map(len, left)):]
    begins = np.cumsum([0, *sizes[:-1]])
    mine = np.cumsum([0, *(len(s) for s in left)])
    marks = np.zeros(number.max() + 1, dtype=np.int32)
    for i in range(len(left)):
        at = own[mine[i]:mine[i + 1]]
        after = i + 1 if right is None else 0
        if after == len(others):
            break
        marks[at] = 1
        shared = np.add.reduceat(marks[theirs[begins[after]:]], begins[after:] - begins[after])
        marks[at] = 0
        union = len(at) + sizes[after:] - shared
        for j in np.flatnonzero(whole * shared >= part * union):
            yield i, int(j) + after


class Union:
    """Union-find over the positions of a task's classes."""

    def __init__(self, number: int):
        self.up = list(range(number))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _spanning(part: int, whole: int):
    """Links that join different components of a task's classes.

    With a ``label`` column (the components known before the task), classes of one
    label start united and only links between labels are sent; a task whose classes
    all carry one label has nothing to find and compares nothing.
    """

    def run(group: pa.Table) -> pa.Table:
        keys = group.column("class").to_pylist()
        sides = group.column("side").to_pylist()
        union, out = Union(len(keys)), ([], [])
        if "label" in group.column_names:
            labels = group.column("label").to_pylist()
            if len(set(labels)) == 1:
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            first_of: dict[int, int] = {}
            for i, label in enumerate(labels):
                union.join(first_of.setdefault(label, i), i)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()]
        one, two = ([i for i, s in enumerate(sides) if s == k] for k in (0, 1))
        first = [i for i, s in enumerate(sides) if s != 1]
        if two:
            pairs = ((one[i], two[j]) for i, j in linked_pairs([sets[i] for i in one], [sets[j] for j in two], part, whole)) if one else ()
        else:
            pairs = ((first[i], first[j]) for i, j in linked_pairs([sets[i] for i in first], None, part, whole))
        for i, j in pairs:
            if union.join(i, j):
                out[0].append(keys[i])
                out[1].append(keys[j])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _tasks(members: DataFrame) -> DataFrame:
    """Rows (task key, side, class) from rows (cell, class, n) so that all pairs of a cell meet.

    A cell above the size of a block is dealt into blocks by hash; each pair of
    blocks is a task, and a block also meets itself.
    """
    size = materialize(members.groupBy("cell").agg(F.count("*").alias("classes"), F.sum("n").alias("total")).where(
        "classes > 1").select("cell", F.greatest(
            F.ceil(F.col("total") / TASK_SHINGLES), F.ceil(F.col("classes") / TASK_CLASSES)).cast("int").alias("blocks")), "cells")
    dealt = members.join(size, "cell").withColumn("block", F.pmod(F.xxhash64("class", "cell"), F.col("blocks")).cast("int"))
    return dealt.select(
        "cell", "class", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("block") == F.col("other"), -1).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "class")


def near_duplicates(docs: DataFrame, part: int = 80, whole: int = 100, shingle: int = SHINGLE, key: str = "doc_id",
                    text: str = "text", cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """Groups of documents whose shingle sets overlap: whole * intersection >= part * union.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document
    of fewer words than a shingle is one shingle.  Returns a row per document:
    doc_id, text_key (md5 of its text), n_shingles, digest (of its set), component
    (a number of its group; null without words), component_id (the smallest
    doc_id of the group, its own without words) and kept (doc_id = component_id).
    Links are exact; a pair at the threshold fails to become a candidate with
    probability ``MISS``.  Null texts are empty and linked with nothing; a null id
    is never the smallest unless all of its group are null; repeated rows fall in
    one group; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    bands, rows = band_shape(part / whole)
    names = [f"band{k}" for k in range(bands)]
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.md5(F.col(text).cast("string")).alias("text_key"),
                         F.col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.StringType()),
        T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
        *(T.StructField(n, T.LongType()) for n in names)])
    features = materialize(source.mapInArrow(_features(shingle, bands, rows), schema), "features")
    classes = materialize(
        features.where("digest is not null").groupBy("digest").agg(
            F.min("doc_id").alias("least"), F.min("n_shingles").alias("n"), *(F.min(n).alias(n) for n in names))
        .withColumn("class", F.monotonically_increasing_id()), "classes")
    links = _links(source, classes, names, part, whole, shingle, cell_shingles)
    joined = connected_components(links)
    named = classes.select("digest", "class", "least").join(
        joined.select(F.col("node").alias("class"), "component"), "class", "left").select(
        "digest", "least", F.coalesce("component", "class").alias("component"))
    named = materialize(named, "named")
    smallest = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    of = materialize(named.join(smallest, "component").select("digest", "component", "component_id"), "groups")
    own = features.select("doc_id", "text_key", "n_shingles", "digest")
    with_words = own.where("digest is not null").join(of, "digest").select(*own.columns, "component", "component_id")
    without = own.where("digest is null").select(*own.columns, F.lit(None).cast("long").alias("component"),
                                                 F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _links(source: DataFrame, classes: DataFrame, names: list[str], part: int, whole: int, shingle: int,
           cell_shingles: int) -> DataFrame:
    """Verified spanning links (a, b) between classes."""
    # a set of n can only be linked to another if n of n + 1 would do
    banded = classes.where(F.col("n") * (whole - part) >= part).select(
        "class", "n", F.explode(F.array(*names)).alias("key"))
    shared = materialize(banded.groupBy("key").agg(
        F.count("*").alias("number"), F.min("class").alias("leader")).where("number > 1").select("key", "leader"), "buckets")
    member = materialize(banded.join(shared, "key"), "members")
    cells = connected_components(member.select(F.col("class").alias("a"), F.col("leader").alias("b")))
    cells = materialize(cells.join(classes.select("class", "n"), cells["node"] == classes["class"]).select(
        "class", "n", F.col("component").alias("cell")), "cell_members")
    large = materialize(cells.groupBy("cell").agg(F.sum("n").alias("total"), F.count("*").alias("number")).where(
        (F.col("total") > cell_shingles) | (F.col("number") > CELL_CLASSES)).select("cell"), "large_cells")
    small = cells.join(large, "cell", "left_anti").select("cell", "class", "n")
    bucketed = member.join(cells.join(large, "cell", "left_semi").select("class"), "class").select(
        F.col("key").alias("cell"), "class", "n")
    tasks = _tasks(small.withColumn("kind", F.lit(0)).unionByName(bucketed.withColumn("kind", F.lit(1))).select(
        F.struct("kind", "cell").alias("cell"), "class", "n"))
    wanted = cells.select("class").join(classes.select("class", "digest", "least"), "class")
    texts = source.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("least"))).select(
        "class", "digest", "text")
    sets = materialize(texts.mapInArrow(_wanted_sets(shingle), "class long, shingles binary").dropDuplicates(["class"]), "sets")
    tasks = materialize(tasks, "tasks")
    # blocks with themselves first: their links are a forest, fewer than their classes
    inside = materialize(tasks.where("low = high").join(sets, "class").groupBy("cell", "low", "high").applyInArrow(
        _spanning(part, whole), "a long, b long"), "links")
    known = connected_components(inside).select(F.col("node").alias("class"), F.col("component").alias("label"))
    # pairs of blocks then only join what the blocks left apart
    across = tasks.where("low < high").join(known, "class", "left").withColumn(
        "label", F.coalesce("label", "class")).join(sets, "class")
    between = materialize(across.groupBy("cell", "low", "high").applyInArrow(
        _spanning(part, whole), "a long, b long"), "links")
    return inside.unionByName(between)
