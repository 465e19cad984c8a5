"""Lempel-Ziv phrase fingerprints: compression-like likeness of whole texts.

A text's UTF-8 bytes are parsed the LZ78 way over an alphabet of words (a run of
non-space bytes with its spaces): each phrase is the longest phrase already in the
text's own dictionary plus one word, and becomes a dictionary phrase itself.
Texts that share long passages share many phrases, much as a compressor would
find them.  Each phrase is hashed by the content of its byte span, the set of
phrase hashes is reduced to a signature of ``SLOTS`` minimum hashes of 16 bits
(b-bit minwise hashing), and two fingerprints are alike by the share of equal
slots, an estimate of the Jaccard similarity of their phrase sets.

The parse runs per text inside Python tasks that Spark deals; edits, positions and
joins between neighbours are Spark expressions and joins.

Edge cases: a null text is empty; an empty text has no phrases, a fingerprint of
empty slots, likeness 1 to another empty one and 0 to any other.  Equal texts have
equal fingerprints.  Very long texts are parsed whole.  Repeated rows and equal
doc_ids are separate documents, ordered by text within an id; a null doc_id comes
after all others in the descending order.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.words import _hashes, mix
from flowlab.scratch import materialize

SLOTS = 64
_SEEDS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CHUNK = 4096
EMPTY = "ffff" * SLOTS
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


_SYMBOL = re.compile(rb"\s*\S+\s*|\s+")


def phrase_ends(data: bytes) -> np.ndarray:
    """Byte offsets where the LZ78 phrases of ``data`` end; phrase k starts at the end of k - 1.

    Symbols are words: a run of non-space bytes with the spaces around it (leading
    spaces only at the start of a text).  A phrase grows while it is in the text's
    own dictionary and ends at the first symbol that makes it new; the unfinished
    tail repeats a phrase already there and adds nothing.
    """
    symbols = _SYMBOL.findall(data)
    vocabulary: dict[bytes, int] = {}
    ids = [vocabulary.setdefault(t, len(vocabulary)) for t in symbols]
    bounds = np.cumsum(np.fromiter(map(len, symbols), dtype=np.int64, count=len(symbols)))
    trie: dict[int, int] = {}
    get = trie.get
    ends = []
    node = 0
    made = 1
    for i, symbol in enumerate(ids):
        key = node * 4_294_967_296 + symbol
        child = get(key)
        if child is None:
            trie[key] = made
            made += 1
            ends.append(i)
            node = 0
        else:
            node = child
    return bounds[np.array(ends, dtype=np.int64)] if ends else np.empty(0, dtype=np.int64)


def phrase_hashes(data: bytes) -> np.ndarray:
    """Distinct content hashes of the LZ78 phrases of ``data``."""
    ends = phrase_ends(data)
    if not len(ends):
        return np.empty(0, dtype=np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    return np.unique(_hashes(np.frombuffer(data, dtype=np.uint8), starts, ends))


def slots(hashes: np.ndarray) -> np.ndarray:
    """The ``SLOTS`` minimum hashes of a phrase set, as 16-bit values (all ones when empty)."""
    low = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at:at + _CHUNK]
        low = np.minimum(low, mix(part[:, None] ^ _SEEDS[None, :]).min(axis=0))
    return (low >> np.uint64(48)).astype(np.uint16)


def signature(data: bytes) -> str:
    """The fingerprint of a text: ``SLOTS`` 16-bit minimum hashes of its phrase set, as hex."""
    hashes = phrase_hashes(data)
    if not len(hashes):
        return EMPTY
    return slots(hashes).astype(">u2").tobytes().hex()


def alike(a: str, b: str) -> float:
    """Share of equal slots of two fingerprints."""
    x = np.frombuffer(bytes.fromhex(a), dtype=">u2")
    y = np.frombuffer(bytes.fromhex(b), dtype=">u2")
    return float((x == y).mean())


BLOCK_ROWS = 20_000
_DEALT = ("kind string, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double, text string, cut int")


def _edit(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range block in descending order: every row but the last is paired with the row after it.

    The last row leaves its head and the first row its whole text for the pairing
    across blocks; both are one document a block.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    rows = [r for batch in batches for r in zip(batch["doc_id"], batch["text"])]
    if not rows:
        return
    prints = [signature(t.encode()) for _, t in rows]
    out = []
    for i, (doc_id, text) in enumerate(rows[:-1]):
        edited = _edit(text, rows[i + 1][1])
        mine = signature(edited.encode())
        out.append(("done", part, doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[i], mine,
                    alike(prints[i], mine), alike(prints[i], prints[i + 1]), None, None))
    doc_id, text = rows[-1]
    cut = len(text) // 3
    out.append(("last", part, doc_id, len(text), None, prints[-1], None, None, None, text[:len(text) - cut], cut))
    out.append(("first", part, rows[0][0], len(rows[0][1]), None, prints[0], None, None, None, rows[0][1], None))
    yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in _DEALT.split(", ")]).astype(
        {"part": "int32", "doc_id": "Int64", "n_chars": "int64", "cut": "Int32"})


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last row of a block with the first row of the next non-empty block."""
    for batch in batches:
        edited = [head + following[:cut] for head, following, cut in zip(batch["head"], batch["following"], batch["cut"])]
        prints = [signature(e.encode()) for e in edited]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"], "n_chars": batch["n_chars"],
            "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            "fingerprint": batch["fingerprint"], "edited_fingerprint": prints,
            "near_edited": [alike(a, b) for a, b in zip(batch["fingerprint"], prints)],
            "near_next": [alike(a, b) for a, b in zip(batch["fingerprint"], batch["next_fingerprint"])],
        })


def fingerprint_texts(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document in descending doc_id.

    The edit replaces the last ``floor(n_chars / 3)`` code points by as many leading
    code points of the next document (all of it if shorter); the last document is
    followed by the first.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next.

    Texts move once: they are range-partitioned in that order into blocks of about
    ``BLOCK_ROWS`` rows, and neighbours inside a block are paired where they are.
    Only the last row of each block meets the first row of the next non-empty
    block, by a join of two documents a block.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn(
        "_rid", F.monotonically_increasing_id())
    count = docs.count()
    if count == 0:
        return spark.createDataFrame([], RESULT)
    blocks = max(1, -(-count // BLOCK_ROWS))
    order = [F.col("doc_id").isNull(), F.bitwise_not("doc_id"), F.col("text"), F.col("_rid")]
    dealt = materialize(docs.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
                        .select("doc_id", "text").mapInPandas(_neighbours, _DEALT), "lz-dealt")
    heads = dealt.where("kind = 'first'").select("part")
    # one row per non-empty block: the block that follows it, cyclically
    after = Window.orderBy("part")
    following = heads.select("part", F.coalesce(F.lead("part").over(after), F.min("part").over(
        after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    last = dealt.where("kind = 'last'").join(following, "part").select(
        "next_part", "doc_id", "n_chars", "fingerprint", F.col("text").alias("head"), "cut")
    first = dealt.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"),
                                                 F.col("fingerprint").alias("next_fingerprint"))
    across = last.join(first, "next_part").mapInPandas(
        _across, RESULT)
    done = dealt.where("kind = 'done'").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return done.unionByName(across)
