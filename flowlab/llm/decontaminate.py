"""Benchmark decontamination by multi-pattern search with block shifts.

Patterns are windows of consecutive benchmark words, and words are the symbols.
For a pattern of m words, a table gives for every block of B words how far the
window may move before a pattern could end: m - B + 1 for a block of no pattern,
less for a block that stands further left in one, 0 for a last block.  Where the
shift is 0, the suffix block and the words before it select test strings from a
sorted bucket table, and a comparison of the words themselves confirms.

Texts are cut into lanes of window ends that move independently, so one numpy
step moves all lanes of a block of texts.  Patterns go to the tasks in blocks of
a fixed size; each further block is another pass over the texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.words import ALNUM, Words, blocks, mix, run_rows, small_batches
from flowlab.scratch import materialize

WINDOW = 13
BLOCK_WORDS = 3
BLOCK_WINDOWS = 200_000
LANE = 256
_TABLE_BITS = 20


class Patterns:
    """Shift and bucket tables for the distinct patterns of one length."""

    def __init__(self, length: int, texts: list[bytes]):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        words = Words(texts, ALNUM)
        hashes = words.hashes.reshape(len(texts), length)
        self.shift = np.full(1 << _TABLE_BITS, length - self.block + 1, dtype=np.int32)
        for end in range(self.block - 1, length):
            cells = self._cells(self._blocks(hashes[:, end - self.block + 1:end + 1]))
            np.minimum.at(self.shift, cells, length - 1 - end)
        keys = run_rows(hashes)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.texts = texts

    @staticmethod
    def _blocks(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=np.uint64)
        for k in range(hashes.shape[1]):
            out = mix(out + hashes[:, k])
        return out

    @staticmethod
    def _cells(block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def ends(self, words: Words) -> np.ndarray:
        """Places where some pattern may end: the shift of the block there is 0."""
        lanes, stops = [], []
        for first, count in zip(words.first[:-1], words.counts):
            if count >= self.length:
                begin = np.arange(first + self.length - 1, first + count, LANE)
                lanes.append(begin)
                stops.append(np.minimum(begin + LANE, first + count))
        if not lanes:
            return np.empty(0, dtype=np.int64)
        at, stop, found = np.concatenate(lanes), np.concatenate(stops), []
        offsets = np.arange(1 - self.block, 1)
        while len(at):
            step = self.shift[self._cells(self._blocks(words.hashes[at[:, None] + offsets]))]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(found)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words and pattern numbers of all occurrences."""
        starts = self.ends(words) - self.length + 1
        if not len(starts):
            return starts, starts
        keys = run_rows(words.hashes[starts[:, None] + np.arange(self.length)])
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        hits: tuple[list[int], list[int]] = ([], [])
        for i in np.flatnonzero(low < high):
            text = b" ".join(words.text(starts[i], starts[i] + self.length))
            for j in range(low[i], high[i]):
                if self.texts[self.order[j]] == text:
                    hits[0].append(starts[i])
                    hits[1].append(self.order[j])
        return np.array(hits[0], dtype=np.int64), np.array(hits[1], dtype=np.int64)


class Search:
    """Tables of a block of patterns by length, and the items of each pattern."""

    def __init__(self, rows: list[tuple[str, str]]):
        items: dict[bytes, set[str]] = defaultdict(set)
        for text, item in rows:
            items[text.encode()].add(item)
        lengths: dict[int, list[bytes]] = defaultdict(list)
        for text in sorted(items):
            lengths[text.count(b" ") + 1].append(text)
        self.groups = [(Patterns(n, texts), [items[t] for t in texts]) for n, texts in lengths.items()]

    def __call__(self, words: Words, spans: list, items: list) -> None:
        """Adds hit spans and items to the given ones, text by text."""
        for patterns, of in self.groups:
            starts, found = patterns.search(words)
            for start, doc, pattern in zip(starts, np.searchsorted(words.first, starts, side="right") - 1, found):
                at = int(start - words.first[doc])
                spans[doc].append((at, at + patterns.length))
                items[doc] |= of[pattern]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, that cover the same places."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(spans)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _scan(search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = search.value
        for batch in batches:
            counts, spans = [], [[(s["first"], s["end"]) for s in old] for old in batch.column("spans").to_pylist()]
            items = [set(old) for old in batch.column("items").to_pylist()]
            for first, texts in blocks(batch.column("text").to_pylist()):
                words, upto = Words(texts, ALNUM), first + len(texts)
                counts.extend(words.counts.tolist())
                own_spans, own_items = spans[first:upto], items[first:upto]
                tables(words, own_spans, own_items)
                items[first:upto] = own_items
            merged = [merge_spans(s) for s in spans]
            made = {
                "n_words": pa.array(counts, pa.int64()),
                "n_hit": pa.array([sum(b - a for a, b in s) for s in merged], pa.int64()),
                "items": pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                "spans": pa.array([[{"first": a, "end": b} for a, b in s] for s in merged], _SPANS),
            }
            kept = [n for n in batch.schema.names if n not in made]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), *made.values()], names=[*kept, *made])

    return run


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("item").to_pylist()
            for first, texts in blocks(batch.column("text").to_pylist()):
                words = Words(texts, ALNUM, hashed=False)
                out: tuple[list[str], list[str]] = ([], [])
                for i, (begin, count) in enumerate(zip(words.first[:-1], words.counts)):
                    own = [w.decode() for w in words.text(begin, begin + count)]
                    wide = min(size, len(own))
                    for at in range(len(own) - wide + 1 if own else 0):
                        out[0].append(" ".join(own[at:at + wide]))
                        out[1].append(keys[first + i])
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["window", "item"])

    return run


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                   carry: list[str] | None = None, item: str = "item_id", item_text: str = "text",
                   block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Find every benchmark window in every document.

    Returns a row per document: ``doc`` (a struct of the columns named in
    ``carry``, all by default, under their own names), ``n_words``, ``n_hit``
    (words inside an occurrence), ``items`` (ids, as text, of the items with
    occurring windows) and ``spans`` (disjoint word ranges that are hit, ends
    excluded).  An item of fewer words than the window is one window; an item
    without words, a null text or a null item id has none.  A null or empty
    document has no words.  Repeated rows, of either table, count as they stand;
    an empty benchmark hits nothing; an empty table gives no rows.

    The windows are held ``block_windows`` at a time; more make further passes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shown = docs.columns if carry is None else carry
    found = docs.select(
        F.struct(*(docs[c] for c in shown)).alias("doc"), docs[text].cast("string").alias("text"),
        F.expr("cast(array() as array<string>)").alias("items"),
        F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)").alias("spans"))
    windows = materialize(
        benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
        .where("item is not null").mapInArrow(_windows(window), "window string, item string"), "windows")
    passes = max(1, -(-windows.count() // block_windows))
    schema = found.select("doc", "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                          "items", "spans").schema
    for k in range(passes):
        block = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == k).distinct()
        search = spark.sparkContext.broadcast(Search([tuple(r) for r in block.collect()]))
        found = found.mapInArrow(_scan(search), schema)
        if k + 1 < passes:
            found = materialize(found.select("doc", "text", "items", "spans"), "scanned")
    return found.drop("text")
