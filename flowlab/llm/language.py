"""Language identification by nearest centroids of TF-IDF letter n-grams.

A text becomes counts of n-grams of one to three characters, hashed to a fixed
number of features, damped, weighted by inverse document frequency, and
normalised.  Each language has several centroids, found by clustering a bounded
sample of its labelled rows; document frequencies come from all labelled rows.
A text goes to the language of the nearest centroid by cosine, and is rejected
if that centroid is further away than the language's own texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.words import mix, small_batches
from flowlab.scratch import materialize

FEATURE_BITS = 13
LONGEST_GRAM = 3
SAMPLE_ROWS = 400
CENTROIDS = 3
MAX_LANGUAGES = 1_000
PARTS = 16
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or a space if it is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def grams(text: str) -> np.ndarray:
    """Feature numbers of all n-grams of a text, repeats included; none without letters.

    Runs of anything but letters count as one space, which also stands at both
    ends.  No n-gram reaches from one word into another.
    """
    codes = _letters()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    blank = codes == 32
    codes = np.concatenate([[32], codes[~(blank & np.concatenate([[True], blank[:-1]]))], [32]]).astype(np.uint64)
    if len(codes) < 3 or not (codes != 32).any():
        return np.empty(0, dtype=np.int64)
    if codes[-2] == 32:
        codes = codes[:-1]
    made, rolled = [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, min(LONGEST_GRAM, len(codes)) + 1):
        rolled = rolled[:len(codes) - n + 1] * np.uint64(0x110000) + codes[n - 1:]
        own = rolled[codes[n // 2:len(rolled) + n // 2] != 32] if n != 2 else rolled
        made.append(mix(own + np.uint64(n)) >> np.uint64(64 - FEATURE_BITS))
    return np.concatenate(made).astype(np.int64)


def counts_of(text: str | None, piece: int = 1 << 20) -> np.ndarray:
    """Counts per feature over the whole text; long texts are taken in pieces cut at spaces."""
    out, at, text = np.zeros(1 << FEATURE_BITS, dtype=np.int64), 0, text or ""
    while at < len(text):
        end = text.find(" ", at + piece)
        end = len(text) if end < 0 else end
        out += np.bincount(grams(text[at:end]), minlength=len(out))
        at = end
    return out


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf at unit length; all zero without letters."""
    out = np.log1p(counts) * idf
    size = np.sqrt(out @ out)
    return out / size if size else out


class Model:
    """Unit centroids, the language of each, and the least cosine each language accepts."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, of: list[int], languages: list[str], least: np.ndarray):
        self.idf, self.centroids, self.of, self.languages, self.least = idf, centroids, np.array(of), languages, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = counts_of(text)
        if not counts.any() or not self.languages:
            return UNKNOWN, 0.0, bool(counts.any())
        cosines = self.centroids @ vector(counts, self.idf)
        best = int(np.argmax(cosines))  # ties: the first language by name
        near = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[self.of[best]], near, near >= self.least[self.of[best]]


def cluster(points: np.ndarray, number: int, rounds: int = 12, smallest: float = 0.05) -> np.ndarray:
    """Spherical k-means from far-apart starting points; the result is fixed by the rows.

    Clusters with less than a share ``smallest`` of the points are stray rows, such
    as wrong labels, and give no centroid.
    """
    centres = [points.mean(axis=0)]
    centres[0] = points[np.argmax(points @ centres[0])]
    nearest = points @ centres[0]
    while len(centres) < number and nearest.min() < 1 - 1e-9:
        centres.append(points[np.argmin(nearest)])
        nearest = np.maximum(nearest, points @ centres[-1])
    made = np.array(centres)
    for _ in range(rounds):
        owner = np.argmax(points @ made.T, axis=1)
        for k in np.unique(owner):
            total = points[owner == k].sum(axis=0)
            made[k] = total / np.sqrt(total @ total)
    sizes = np.bincount(np.argmax(points @ made.T, axis=1), minlength=len(made))
    return made[sizes >= min(sizes.max(), smallest * len(points))]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(1 << FEATURE_BITS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            counts = counts_of(text.as_py())
            seen += counts > 0
            rows += bool(counts.any())
    if rows:
        have = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *have.tolist()], pa.int64()), pa.array([rows, *seen[have].tolist()], pa.int64())],
            names=["feature", "rows"])


def _centroids(idf: np.ndarray, number: int, share: float):
    def run(group: pa.Table) -> pa.Table:
        points = [vector(counts_of(t.as_py()), idf) for t in group.column("text")]
        points = np.array([p for p in points if p.any()])
        if not len(points):
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary()),
                             "least": pa.array([], pa.float64())})
        made = cluster(points, number)
        least = share * float(np.quantile((points @ made.T).max(axis=1), 0.01))
        return pa.table({"lang": [group.column("lang")[0].as_py()] * len(made),
                         "centroid": pa.array([c.astype("<f8").tobytes() for c in made], pa.binary()),
                         "least": [least] * len(made)})

    return run


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS,
        centroids: int = CENTROIDS, reject_share: float = 0.25) -> Model:
    """Learn from rows with a text and a language; others are ignored.

    Document frequencies cover all of them.  Centroids come from ``sample_rows``
    distinct texts of each language, the first by a hash.  A language accepts
    texts down to ``reject_share`` times the cosine that 99 of 100 sampled texts reach.
    Without labelled rows the model knows no language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    seen = rows.select("text").mapInArrow(_presence, "feature long, rows long").groupBy("feature").agg(
        F.sum("rows").alias("rows")).collect()  # one row for each feature at most
    total = next((r["rows"] for r in seen if r["feature"] == -1), 0)
    idf = np.full(1 << FEATURE_BITS, np.log(1 + total) + 1)
    for r in seen:
        if r["feature"] >= 0:
            idf[r["feature"]] = np.log((1 + total) / (1 + r["rows"])) + 1
    texts = rows.withColumn("place", F.xxhash64("text"))
    # the lowest hashes of each part of a language first, then of the language
    part, whole = (Window.partitionBy("lang", *p).orderBy("place") for p in (["part"], []))
    bars = (
        texts.select("lang", "place").distinct().withColumn("part", F.pmod("place", F.lit(PARTS)))
        .withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= sample_rows)
        .withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= sample_rows)
        .groupBy("lang").agg(F.max("place").alias("bar"))
    )
    under = texts.join(materialize(bars, "language_bars"), "lang").where("place <= bar")
    sample = under.groupBy("lang", "place").agg(F.min("text").alias("text"))
    made = sample.groupBy("lang").applyInArrow(
        _centroids(idf, centroids, reject_share), "lang string, centroid binary, least double").limit(
        MAX_LANGUAGES * centroids + 1).collect()
    if len(made) > MAX_LANGUAGES * centroids:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    made.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    languages = sorted({r["lang"] for r in made})
    least = {r["lang"]: r["least"] for r in made}
    points = [np.frombuffer(bytes(r["centroid"]), dtype="<f8") for r in made]
    return Model(idf, np.array(points).reshape(len(points), 1 << FEATURE_BITS),
                 [languages.index(r["lang"]) for r in made], languages, np.array([least[k] for k in languages]))


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The language of every whole text.

    Returns a row per document: ``doc`` (a struct of the columns named in
    ``carry``, all by default), ``lang_pred`` (``und`` without letters, and for a
    model without languages), ``score`` (cosine to the nearest centroid) and
    ``accepted`` (a model without languages accepts all that has letters).  A null or empty text has no letters; of equally near languages
    the first by name is taken; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            langs, scores, fits = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(fits, pa.bool_())], names=["doc", "lang_pred", "score", "accepted"])

    shown = docs.columns if carry is None else carry
    source = docs.select(F.struct(*(docs[c] for c in shown)).alias("doc"), docs[text].cast("string").alias("text"))
    schema = source.select("doc", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(True).alias("accepted")).schema
    return source.mapInArrow(run, schema)
