"""Token counts of the sections of documents, from one encoding of each document.

A document is encoded once and whole, so counts add up to its own count.  Every
token has a character span; sections have spans too, and an interval join inside
the document tells which sections a token touches.  A token that crosses a
boundary goes to one section by rule: ``majority`` (most of its characters, ties
to the earlier section), ``first`` or ``last`` (the section of its first or last
character in any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.tokens import encoder

RULES = ("majority", "first", "last")
OUTSIDE = -1


def token_spans(text: str, paths: tuple = (None, None)) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token; tokens that share a character overlap there."""
    made = encoder(*paths)
    ends = np.cumsum(made.widths[made.ids(text)], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return (char[starts], char[ends - 1] + 1) if len(ends) else (starts, ends)


def line_spans(text: str) -> np.ndarray:
    """Lines with their line ends, as rows (first, end) that cover the text; one empty row without text."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 0x0A) + 1
    if not len(ends) or ends[-1] < len(text):
        ends = np.append(ends, len(text))
    return np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)


def disjoint(spans: np.ndarray) -> np.ndarray:
    """Sections in order of their starts, cut so that an earlier one keeps shared characters."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.concatenate([[0], np.maximum.accumulate(spans[:, 1])[:-1]]) if len(spans) else np.empty(0, dtype=np.int64)
    starts = np.maximum(spans[:, 0], reach)
    return np.stack([starts, np.maximum(starts, spans[:, 1])], axis=1)


def attribute(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and crossing tokens of each of the disjoint sections, and tokens outside of all."""
    counts, crossing = np.zeros(len(spans), dtype=np.int64), np.zeros(len(spans), dtype=np.int64)
    first = np.searchsorted(spans[:, 1], starts, side="right")
    last = np.searchsorted(spans[:, 0], ends, side="left") - 1
    inside = first <= last
    one = inside & (first == last)
    counts += np.bincount(first[one], minlength=len(spans))
    # a token may also reach from a section into a gap
    reaching = one & ((starts < spans[np.minimum(first, len(spans) - 1), 0]) | (ends > spans[np.minimum(first, len(spans) - 1), 1]))
    crossing += np.bincount(first[reaching], minlength=len(spans))
    for t in np.flatnonzero(inside & (first < last)):
        touched = np.arange(first[t], last[t] + 1)
        shared = np.minimum(ends[t], spans[touched, 1]) - np.maximum(starts[t], spans[touched, 0])
        touched, shared = touched[shared > 0], shared[shared > 0]
        crossing[touched] += 1
        counts[touched[{"majority": int(np.argmax(shared)), "first": 0, "last": -1}[rule]]] += 1
    return counts, crossing, int(np.count_nonzero(~inside))


def _rows(rule: str, paths: tuple, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[np.ndarray] = []
            texts = batch.column("text")
            wanted = batch.column("spans").to_pylist() if given else None
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                if given:
                    own = [(s["first"], s["end"]) for s in wanted[i] or () if s and None not in (s["first"], s["end"])]
                    spans = disjoint(np.clip(np.array(own, dtype=np.int64).reshape(-1, 2), 0, len(text)))
                else:
                    spans = line_spans(text)
                starts, ends = token_spans(text, paths)
                counts, crossing, outside = attribute(starts, ends, spans, rule) if len(spans) else (spans[:, 0], spans[:, 0], len(starts))
                rows = np.column_stack([np.full(len(spans), i), np.arange(len(spans)), spans, counts, crossing,
                                        np.full(len(spans), len(starts))])
                made.append(rows)
                if outside or not len(spans):
                    made.append(np.array([[i, OUTSIDE, 0, 0, outside, 0, len(starts)]]))
            if made:
                table = np.concatenate(made).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(table[:, 0])), *(pa.array(table[:, k]) for k in range(1, 7))],
                    names=["doc_id", "section", "first", "end", "n_tokens", "n_crossing", "doc_tokens"])

    return run


def count_tokens(docs: DataFrame, sections: str | None = None, rule: str = "majority", key: str = "doc_id",
                 text: str = "text", tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Tokens of every section of every document.

    ``sections`` names a column of spans, array<struct<first, end>> in characters;
    without it sections are lines with their line ends.  Returns doc_id, section
    (its place in order of starts; -1 for what lies in none), first, end, n_tokens
    (each token counts once, by ``rule``), n_crossing (tokens that also touch
    characters outside of the section) and doc_tokens.  The n_tokens of a document
    add up to its doc_tokens.  Null texts are empty; an empty text is one empty
    line, or has the one row -1 where spans are given and none remain; spans are
    cut to the text, of overlapping ones the earlier keeps the characters, and
    null spans are left out.  Repeated rows count as they stand, a null key stays
    null, an empty table gives no rows, other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")]
    if sections:
        columns.append(F.col(sections).cast("array<struct<first:bigint,end:bigint>>").alias("spans"))
    source = docs.select(*columns)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        _rows(rule, (tokenizer, ranks), sections is not None),
        f"doc_id {kind}, section long, first long, end long, n_tokens long, n_crossing long, doc_tokens long")
