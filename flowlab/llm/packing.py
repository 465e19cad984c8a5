"""Pack token sequences into fixed windows by minimum bin slack.

Whole windows of a document become sequences of their own.  What remains of each
document is a length below the capacity, so the corpus is a table of at most
``capacity`` length counts.  The plan is made on those counts alone: the longest
remaining length opens a window, a bitset subset-sum over the counted lengths
finds the multiset that fills the window closest to capacity, backtracking gives
its counts, and the pattern repeats as often as the counts allow.  A gap that no
multiset fills is closed by cutting a piece, and the last tokens go to windows of
powers of two, which need no padding.

Pieces are ranked within their length without moving them: the task that
tokenizes counts each length, and a prefix sum over tasks turns that into global
ranks.  A row of the plan covers a range of ranks.  Only length counts and the
plan, both bounded by the capacity, pass through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.llm.tokens import encoder
from flowlab.llm.words import small_batches
from flowlab.scratch import materialize

CAPACITY = 2048


def best_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """The counted lengths whose sum comes closest to ``room`` from below.

    ``counts`` is walked in its own order.  A length with count c enters as
    groups of 1, 2, 4, ... of it, at most as many as fit; one integer holds the
    reachable sums as bits, and the sums before each group allow backtracking.
    """
    full = (1 << (room + 1)) - 1
    sums, layers = 1, []
    for length, count in counts.items():
        left, group = min(count, room // length), 1
        while left:
            take = min(group, left)
            after = sums | (sums << (length * take)) & full
            if after != sums:
                layers.append((length, take, sums))
                sums = after
            left, group = left - take, group * 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


class _Pool:
    """Remaining pieces by length, as ranges of ranks: (whole length, cut from, low, high)."""

    def __init__(self, counts: dict[int, int]):
        self.ranges = {n: [(n, 0, 0, c)] for n, c in counts.items() if c}
        self.counts = {n: counts[n] for n in sorted(self.ranges, reverse=True)}
        self.total = sum(n * c for n, c in self.counts.items())

    def take(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        out, held = [], self.ranges[length]
        self.counts[length] -= number
        self.total -= length * number
        while number:
            whole, cut, low, high = held.pop()
            got = min(number, high - low)
            out.append((whole, cut, low, low + got))
            if low + got < high:
                held.append((whole, cut, low + got, high))
            number -= got
        if not self.counts[length]:
            del self.counts[length], self.ranges[length]
        return out

    def put(self, length: int, ranges: list[tuple[int, int, int, int]]) -> None:
        number = sum(high - low for _, _, low, high in ranges)
        self.ranges.setdefault(length, []).extend(ranges)
        self.total += length * number
        if length in self.counts:
            self.counts[length] += number
        else:
            self.counts = dict(sorted([*self.counts.items(), (length, number)], reverse=True))


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Rows (length, cut, size, low, high, sequence, offset).

    The pieces of ``length`` with ranks from ``low`` up to ``high`` give their
    ``size`` tokens from ``cut`` on to the sequences ``sequence``,
    ``sequence + 1``, ..., at ``offset``.  Every token of every piece is in
    exactly one row; all sequences are full, or have a power of two of tokens.
    """
    pool, rows, sequence = _Pool(counts), [], 0
    while pool.total:
        room = capacity if pool.total >= capacity else 1 << (pool.total.bit_length() - 1)
        longest = next((n for n in pool.counts if n <= room), None)
        if longest is None:
            used: dict[int, int] = {}
        else:
            rest = {n: c - (n == longest) for n, c in pool.counts.items() if n <= room - longest and c > (n == longest)}
            used = best_multiset(rest, room - longest)
            used[longest] = used.get(longest, 0) + 1
        gap = room - sum(n * c for n, c in used.items())
        left = {n: c - used.get(n, 0) for n, c in pool.counts.items() if n > gap and c > used.get(n, 0)}
        cut = min(left) if gap and left else None
        times = min((pool.counts[n] // c for n, c in used.items()), default=1 << 62)
        if cut is not None:
            times = min(times, pool.counts[cut] // (used.get(cut, 0) + 1))
        if room < capacity:
            times = 1
        offset = 0
        for size in sorted(used, reverse=True):
            for _ in range(used[size]):
                at = sequence
                for whole, start, low, high in pool.take(size, times):
                    rows.append((whole, start, size, low, high, at, offset))
                    at += high - low
                offset += size
        if cut is not None:
            at, taken = sequence, pool.take(cut, times)
            for whole, start, low, high in taken:
                rows.append((whole, start, gap, low, high, at, offset))
                at += high - low
            pool.put(cut - gap, [(whole, start + gap, low, high) for whole, start, low, high in taken])
        sequence += times
    return rows


_PIECES = T.StructType([
    T.StructField("task", T.IntegerType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("rank", T.LongType()),
    T.StructField("crc", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
])


def _ids(text: str | None, end_id: int, paths: tuple) -> np.ndarray:
    return np.array([*encoder(*paths).ids(text or ""), end_id], dtype="<u4")


def _piece_rows(capacity: int, end_id: int, paths: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = _ids(text.as_py(), end_id, paths)
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    out.append((key, start, len(piece), int(seen[len(piece)]), zlib.crc32(piece.tobytes()), len(ids)))
                    seen[len(piece)] += 1
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(out), task, dtype=np.int32)), *columns], names=_PIECES.names)

    return run


def _last_pieces(capacity: int, end_id: int, paths: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                ids = _ids(text.as_py(), end_id, paths)
                start = (len(ids) - 1) // capacity * capacity
                data = ids[start:].tobytes()
                out.append((start, len(ids) - start, zlib.crc32(data), data))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns],
                                                 names=["of", "start", "length", "crc", "ids"])

    return run


def pack_sequences(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 1, key: str = "doc_id",
                   text: str = "text", tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Place every token of every document in exactly one sequence.

    Returns a row per piece: doc_id, start (tokens of its document before it),
    length, ids_crc32 (of its ids as little-endian unsigned 32-bit numbers),
    doc_tokens, sequence_id, offset.  A null or empty text is one ``end_id``; a
    null key stays null; repeated rows are documents of their own; an empty table
    gives no rows; other columns are ignored.  ``tokenizer`` and ``ranks`` name
    the two files of the vocabulary.
    """
    spark, paths = docs.sparkSession, (tokenizer, ranks)
    small_batches(spark)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = materialize(source.mapInArrow(_piece_rows(capacity, end_id, paths), _PIECES), "pieces")
    by_task = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("number")), "piece_counts")
    counts = {r["length"]: r["number"] for r in by_task.groupBy("length").agg(F.sum("number").alias("number")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        pieces.join(by_task.select("length", "task", F.coalesce(F.sum("number").over(before), F.lit(0)).alias("base")),
                    ["length", "task"])
        .withColumn("place", F.col("base") + F.col("rank"))
    )
    rows = plan_windows(counts, capacity)
    plan = F.broadcast(spark.createDataFrame(  # at most a few rows for each length and each of its uses
        rows, "length int, cut long, size long, low long, high long, first long, offset long"))
    placed = ranked.join(plan, "length").where("place >= low and place < high").select(
        "doc_id", F.col("start"), "length", "cut", "size", "crc", "doc_tokens",
        (F.col("first") + F.col("place") - F.col("low")).alias("sequence_id"), "offset")
    whole = placed.where("size = length").select(
        "doc_id", "start", F.col("size").alias("length"), F.col("crc").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")
    if all(row[0] == row[2] for row in rows):
        return whole
    return whole.unionByName(_cut_pieces(source, placed.where("size < length"), capacity, end_id, paths))


def _cut_pieces(source: DataFrame, cut: DataFrame, capacity: int, end_id: int, paths: tuple) -> DataFrame:
    """The cut parts with checksums of their own.

    Their documents are found by key and tokenized again.  Texts that share a key
    are told apart by place, length and checksum of their last piece; where these
    agree the ids agree, so one of them stands for all.
    """
    cut = materialize(cut, "cut_pieces")
    wanted = cut.select("doc_id").distinct()
    texts = source.join(wanted, source["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    known = texts.mapInArrow(
        _last_pieces(capacity, end_id, paths), "of long, start long, length int, crc long, ids binary",
    ).dropDuplicates(["of", "start", "length", "crc"])
    same = F.col("of").eqNullSafe(F.col("doc_id"))
    for name in ("start", "length", "crc"):
        same = same & (cut[name] == known[name])
    part = F.substring(F.col("ids"), F.col("cut").cast("int") * 4 + 1, F.col("size").cast("int") * 4)
    return cut.join(known, same).select(
        "doc_id", (cut["start"] + F.col("cut")).alias("start"), F.col("size").alias("length"),
        F.crc32(part).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
