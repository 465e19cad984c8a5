"""Score texts with a probabilistic suffix tree learned from the corpus.

A text is its lower-cased words, one space between them, and an end sign; the
symbols of the tree are bytes.  Counts of byte n-grams come from all training
documents.  A context stays in the tree if what it tells beyond the context one
byte shorter is worth it: its share of the corpus times the divergence of its
next-symbol distribution from its parent's must reach a threshold, and the gain
over its own occurrences must exceed one nat per next symbol.  The gains of one
depth cannot add up to more than the logarithm of the alphabet, so the
threshold bounds the tree whatever the corpus holds.  Distributions are smoothed
by those of the next shorter context, which weighs as much as the context has
different next symbols, down to smoothed symbol shares.  A symbol
is scored in the state of the longest suffix of the text before it.

Beside it stands a word unigram score.  Counts of the most frequent words go to
every task; all other words are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.words import SPACED, Words, blocks
from flowlab.scratch import materialize

DEPTH = 5
GAIN = 1e-6
HEAD_WORDS = 1 << 19
_ALPHABET = 252  # bytes that can occur: words hold no white space, space and end sign stand between
_END = 0x0A
_END_WORD = np.uint64(0x656E6421)
_MOST_KEYS = 2_000_000
_BLOCK_BYTES = 1 << 20
_WORD, _GRAM = 0, 1


def stream(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ``depth`` end signs, and the first place of each text's own bytes."""
    parts, begins, at, pad = [], [], 0, bytes([_END]) * depth
    for a, b in zip(words.first[:-1], words.first[1:]):
        text = b" ".join(words.text(a, b)) + b"\n"
        parts += (pad, text)
        begins.append(at + depth)
        at += depth + len(text)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(begins, dtype=np.int64)


def own_places(symbols: np.ndarray, begins: np.ndarray, depth: int) -> np.ndarray:
    """Places of the stream that belong to a text."""
    mask = np.ones(len(symbols), dtype=bool)
    for k in range(1, depth + 1):
        mask[begins - k] = False
    return np.flatnonzero(mask)


def packed(symbols: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The symbol at each place in the lowest byte, those before it in the higher ones."""
    wide, out = symbols.astype(np.uint64), np.zeros(len(places), dtype=np.uint64)
    for k in range(depth + 1):
        out |= wide[places - k] << np.uint64(8 * k)
    return out


class _Counter:
    """Sums of counts by key, in arrays that are merged when they get long."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.held = kind, [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Counts keys; true when the sums should be handed on."""
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > _MOST_KEYS:
            self.parts = [self._merged()]
            self.held = len(self.parts[0][0])
        return self.held > _MOST_KEYS // 2 and len(self.parts) == 1

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in self.parts])).astype(np.int64)

    def rows(self) -> pa.RecordBatch:
        keys, counts = self._merged()
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), self.kind, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)],
            names=["kind", "key", "n"])


def _counts(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = (_Counter(_WORD), _Counter(_GRAM))
        for batch in batches:
            for _, texts in blocks(batch.column("text").to_pylist(), _BLOCK_BYTES):
                words = Words(texts, SPACED)
                symbols, begins = stream(words, depth)
                keys = (np.concatenate([words.hashes, np.full(len(texts), _END_WORD)]),
                        packed(symbols, own_places(symbols, begins, depth), depth))
                for counter, own in zip(counters, keys):
                    if counter.add(own):
                        yield counter.rows()
        for counter in counters:
            if counter.held:
                yield counter.rows()

    return run


class SuffixTree:
    """Dense tables of the retained contexts: children by the byte before, log10 by the next byte."""

    def __init__(self, depth: int, root: dict[int, int], contexts: dict[tuple[int, int], dict[int, int]]):
        total = sum(root.values())
        symbols = sorted(root)
        self.depth, size = depth, len(symbols) + 1
        self.code = np.full(256, len(symbols), dtype=np.int64)
        self.code[symbols] = np.arange(len(symbols))
        names = [(0, 0), *sorted(contexts)]
        number = {name: i for i, name in enumerate(names)}
        self.sink = len(names)
        self.child = np.full((len(names) + 1, size), self.sink, dtype=np.int32)
        shares = np.zeros((len(names) + 1, size))
        shares[0] = 0.5 / (total + 0.5 * _ALPHABET)
        shares[0, :-1] = [(root[s] + 0.5) / (total + 0.5 * _ALPHABET) for s in symbols]
        for (length, context), i in number.items():
            if not length:
                continue
            up = number[length - 1, context & (1 << 8 * (length - 1)) - 1]
            self.child[up, self.code[context >> 8 * (length - 1)]] = i
            counts = np.zeros(size)
            for symbol, n in contexts[length, context].items():
                counts[self.code[symbol]] = n
            kinds = np.count_nonzero(counts)
            shares[i] = (counts + kinds * shares[up]) / (counts.sum() + kinds)
        shares[self.sink] = 1.0
        self.log = np.log10(shares).astype(np.float32)
        self.size = size

    def scores(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text of a stream."""
        codes, places = self.code[symbols], own_places(symbols, begins, self.depth)
        child, at = self.child.reshape(-1), np.zeros(len(places), dtype=np.int64)
        longest = at
        for k in range(1, self.depth + 1):
            at = child[at * self.size + codes[places - k]].astype(np.int64)
            longest = np.where(at == self.sink, longest, at)
        gained = self.log.reshape(-1)[longest * self.size + codes[places]].astype(np.float64)
        starts = begins - self.depth * np.arange(1, len(begins) + 1)
        return np.add.reduceat(gained, starts) if len(starts) else np.zeros(0)


def fit_tree(grams: DataFrame, depth: int = DEPTH, gain: float = GAIN) -> SuffixTree:
    """The tree from counts (key, n) of packed n-grams of ``depth + 1`` bytes."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    # a context's gain is at most its share times log(total): rarer ones need not be looked at
    floor = gain * total / max(1.0, np.log(max(total, 2)))
    levels: list[DataFrame] = []
    for length in range(depth, -1, -1):
        if length < depth:
            cut = F.col("key").bitwiseAND(F.lit((1 << 8 * (length + 1)) - 1))
            grams = materialize(grams.groupBy(cut.alias("key")).agg(F.sum("n").alias("n")), "grams")
        rows = grams.select(F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(F.lit(255)).alias("symbol"), "n")
        often = rows.groupBy("context").agg(F.sum("n").alias("all")).where(F.col("all") >= floor)
        levels.insert(0, materialize(rows.join(often, "context"), f"contexts{length}"))
    kept: DataFrame | None = None
    found = []
    for length in range(depth, 0, -1):
        shorter = (1 << 8 * (length - 1)) - 1
        up = levels[length - 1].select(F.col("context").alias("up"), "symbol", F.col("n").alias("up_n"), F.col("all").alias("up_all"))
        told = levels[length].withColumn("up", F.col("context").bitwiseAND(F.lit(shorter))).join(up, ["up", "symbol"])
        worth = told.groupBy("context").agg(
            F.sum(F.col("n") * F.log(F.col("n") / F.col("all") * F.col("up_all") / F.col("up_n"))).alias("gain"),
            F.count("*").alias("kinds"))
        own = worth.where((F.col("gain") >= gain * total) & (F.col("gain") > F.col("kinds"))).select("context")
        if kept is not None:
            deeper = (1 << 8 * length) - 1
            own = own.unionByName(kept.select(F.col("context").bitwiseAND(F.lit(deeper)).alias("context"))).distinct()
        kept = materialize(own, f"kept{length}")
        found.append(levels[length].join(kept, "context").select(F.lit(length).alias("length"), "context", "symbol", "n"))
    root = {r["symbol"]: r["n"] for r in levels[0].select("symbol", "n").collect()}
    contexts: dict[tuple[int, int], dict[int, int]] = {}
    table = reduce(DataFrame.unionByName, found).toArrow()  # bounded by the gain, see above
    for length, context, symbol, n in zip(*(table.column(c).to_pylist() for c in ("length", "context", "symbol", "n"))):
        contexts.setdefault((length, context), {})[symbol] = n
    return SuffixTree(depth, root, contexts)


def _heads(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of frequent words: all above the least size step that ``most`` allows."""
    step = F.floor(F.log2("n") * 4)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()  # a few hundred rows
    held, bar = 0, None
    for row in sorted(steps, key=lambda r: -r["step"]):
        held += row["words"]
        if held > most:
            break
        bar = row["step"]
    if bar is None:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    table = counts.where(step >= bar).select("key", "n").toArrow()
    keys, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _scores(shared, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, head_keys, head_counts, end_count = shared.value
        head_logs = np.log10(head_counts + 0.5)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, texts in blocks(batch.column("text").to_pylist(), _BLOCK_BYTES):
                words = Words(texts, SPACED)
                doc = np.repeat(np.arange(len(texts)), words.counts)
                place = np.searchsorted(head_keys, words.hashes)
                place[place == len(head_keys)] = 0
                known = head_keys[place] == words.hashes if len(head_keys) else np.zeros(len(place), dtype=bool)
                base = np.bincount(doc[known], head_logs[place[known]], minlength=len(texts)) + np.log10(end_count + 0.5)
                n_known = np.bincount(doc[known], minlength=len(texts)) + (end_count > 0)
                rest_doc, rest = doc[~known], words.hashes[~known]
                order = np.lexsort((rest, rest_doc))
                rest_doc, rest = rest_doc[order], rest[order]
                new = np.ones(len(rest), dtype=bool)
                new[1:] = (rest[1:] != rest[:-1]) | (rest_doc[1:] != rest_doc[:-1])
                heads = np.flatnonzero(new)
                offsets = pa.array(np.searchsorted(rest_doc[heads], np.arange(len(texts) + 1)), pa.int32())
                times = np.diff(np.append(heads, len(rest)))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + len(texts))), part.column("doc_id"), part.column("held_out"),
                    pa.array(words.counts + 1, pa.int64()), pa.array(n_known.astype(np.int64)), pa.array(base),
                    pa.array(tree.scores(*stream(words, depth))),
                    pa.ListArray.from_arrays(offsets, pa.array(rest[heads].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                ], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"])
                row += len(texts)

    return run


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH,
                gain: float = GAIN, head_words: int = HEAD_WORDS) -> DataFrame:
    """Learn from the rows where ``held_out`` is false and score all.

    Returns a row per document: doc_id, held_out, n_tokens (words and one end),
    n_known (tokens that occur in training), train_tokens, base_score (smoothed
    word unigrams) and score (the suffix tree), both as log10 of the probability
    of the text.  A null or empty text is one end; rows where ``held_out`` is null
    are neither learned from nor held out; repeated rows count as they stand;
    without training rows all symbols are equally likely; an empty table gives no
    rows; other columns are ignored.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("fold"), F.col(text).cast("string").alias("text"))
    counted = source.where(~F.col("fold")).select("text").mapInArrow(_counts(depth), "kind int, key long, n long")
    counts = materialize(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "corpus_counts")
    word_counts = counts.where(F.col("kind") == _WORD).select("key", "n")
    tokens, distinct = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end_row = word_counts.where(F.col("key") == int(_END_WORD)).select("n").first()
    tree = fit_tree(counts.where(F.col("kind") == _GRAM).select("key", "n"), depth, gain)
    shared = docs.sparkSession.sparkContext.broadcast((tree, *_heads(word_counts, head_words), end_row["n"] if end_row else 0))
    scored = materialize(source.select("doc_id", F.coalesce("fold", F.lit(False)).alias("held_out"), "text").mapInArrow(
        _scores(shared, depth),
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
        "words array<long>, times array<long>"), "scored")
    rest = scored.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("word")).select(
        "row", F.col("word.words").alias("key"), F.col("word.times").alias("times"))
    looked = rest.join(word_counts, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest_base"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    each = float(np.log10(tokens + 0.5 * (distinct + 1)))
    return scored.drop("words", "times").join(looked, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"), "score")
