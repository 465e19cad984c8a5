"""Licence notices by sparse TF-IDF cosine, and inheritance along directories.

Templates are bags of words, without function words, weighted by term count and
by inverse frequency among the templates; words of no template weigh the most.  A line is a header notice,
and a whole text a licence file, if its cosine to a template reaches a threshold.
By the Cauchy-Schwarz inequality a unit without any of a template's heaviest words
cannot reach it, so only lines with such a cue word are taken apart.

Files without a notice of their own inherit from the nearest directory above them
that holds a licence file.  Directories, not files, are joined to their ancestors.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.scratch import materialize

# fixed values: customary short notices of common licences
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it under the terms of the GNU General Public License version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
)
WORD = r"[a-z0-9]+(?:[-.][a-z0-9]+)*"
# fixed values: function words, which carry no weight
STOP = frozenset("a an and any are as be by can for from in is it may not of on or that the this to under use with without you".split())
HEADER = 0.75
FILE = 0.5


def words_of(text: str) -> list[str]:
    import re

    return [word for word in re.findall(WORD, text.lower()) if word not in STOP]


class Weights:
    """Weights of template words and the weight of all others."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        bags = [Counter(words_of(text)) for _, text in templates]
        seen = Counter(word for bag in bags for word in bag)
        self.names = [name for name, _ in templates]
        self.idf = {word: math.log((1 + len(bags)) / (1 + n)) + 1 for word, n in seen.items()}
        self.other = math.log(1 + len(bags)) + 1
        self.rows: list[tuple[str, int, str, float]] = []
        for number, (name, bag) in enumerate(zip(self.names, bags)):
            heavy = {word: n * self.idf[word] for word, n in bag.items()}
            size = math.sqrt(sum(x * x for x in heavy.values()))
            self.rows += [(word, number, name, x / size) for word, x in sorted(heavy.items())]

    def cues(self, least: float) -> list[str]:
        """Words of which every unit with a cosine of ``least`` has one: without them too little is left."""
        out = set()
        for number in range(len(self.names)):
            rest = 1.0
            for x, word in sorted(((x, w) for w, k, _, x in self.rows if k == number), key=lambda r: (-r[0], -len(r[1]), r[1])):
                if rest < least * least * (1 - 1e-9):
                    break
                out.add(word)
                rest -= x * x
        return sorted(out)

    def pattern(self, least: float) -> str:
        """A pattern that finds a cue word."""
        return r"(?i)(?<![a-z0-9])(?:" + "|".join(w.replace(".", r"\.") for w in self.cues(least)) + r")(?![a-z0-9])"


def _similar(units: DataFrame, weights: Weights, unit: list[str], words: Column, least: float) -> DataFrame:
    """(unit columns, license, score): the best template of each unit that reaches ``least``.

    A word brings its weight in every template, so one aggregate of a unit's words
    gives its length and its product with each of them.
    """
    table: dict[str, list[float]] = {word: [0.0] * len(weights.names) for word in weights.idf}
    for word, number, _, x in weights.rows:
        table[word][number] = x
    known = F.broadcast(units.sparkSession.createDataFrame(  # the words of the templates
        [(word, weights.idf[word], row) for word, row in table.items()], "word string, idf double, heavy array<double>"))
    terms = units.select(*unit, F.explode(words).alias("word")).groupBy(*unit, "word").agg(F.count("*").alias("times"))
    x = F.col("times") * F.coalesce("idf", F.lit(weights.other))
    made = terms.join(known, "word", "left").groupBy(*unit).agg(
        F.sqrt(F.sum(x * x)).alias("size"),
        *[F.sum(F.coalesce(x * F.get("heavy", F.lit(k)), F.lit(0.0))).alias(f"dot{k}") for k in range(len(weights.names))])
    scores = F.array(*[F.struct((-F.round(F.col(f"dot{k}") / F.col("size"), 6)).alias("low"), F.lit(name).alias("license"))
                       for k, name in enumerate(weights.names)])
    best = made.select(*unit, F.array_min(scores).alias("best"))
    return best.select(*unit, "best.license", (-F.col("best.low")).alias("score")).where(F.col("score") >= least)


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES,
                  header: float = HEADER, whole: float = FILE) -> DataFrame:
    """The licence of every file.

    Returns a row per file: path, license, score (cosine, six digits), origin
    (``file`` where the whole text is near a template, else ``header`` where a
    line is, else ``inherited``, else ``none``) and from_dir (the directory an
    inherited licence is from).  Of equally near templates the first licence by
    name counts; a directory with several licence files has their most frequent
    licence, ties by name; licence files count for their own directory and all
    below it.  A null text has no notice; a null path lies in no directory;
    repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    weights = Weights(templates)
    cue = weights.pattern(min(header, whole))
    rows = files.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    noted = materialize(rows.where(F.col("text").rlike(cue)).withColumn("row", F.monotonically_increasing_id()), "noted")
    own_rows = noted.repartition("row")  # words stay with their row from here on
    lines = own_rows.select("row", F.posexplode(F.split("text", "\n")).alias("line", "value")).where(
        F.col("value").rlike(weights.pattern(header)))
    stop = F.array(*map(F.lit, sorted(STOP)))

    def in_words(column: str) -> Column:
        return F.filter(F.regexp_extract_all(F.lower(column), F.lit(f"({WORD})"), F.lit(1)),
                        lambda word: ~F.array_contains(stop, word))

    headers = _similar(lines, weights, ["row", "line"], in_words("value"), header)
    headers = headers.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("best")).select(
        "row", F.col("best.license").alias("header_license"), (-F.col("best.low")).alias("header_score"))
    wholes = _similar(own_rows, weights, ["row"], in_words("text"), whole).select(
        "row", F.col("license").alias("file_license"), F.col("score").alias("file_score"))
    own = noted.select("row", "path").join(wholes, "row", "left").join(headers, "row", "left")
    own = materialize(own.where("file_license is not null or header_license is not null").select(
        "path", "row", F.coalesce("file_license", "header_license").alias("license"),
        F.coalesce("file_score", "header_score").alias("score"),
        F.when(F.col("file_license").isNotNull(), "file").otherwise("header").alias("origin")), "own_licenses")
    return _inherited(rows, noted, own, cue)


def _directory(path: Column) -> Column:
    """The directory of a path, empty at the top; null for a null path."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def _inherited(rows: DataFrame, noted: DataFrame, own: DataFrame, cue: str) -> DataFrame:
    counts = own.where("origin = 'file' and path is not null").groupBy(_directory(F.col("path")).alias("dir"), "license").agg(
        F.count("*").alias("number"))
    holding = materialize(counts.groupBy("dir").agg(F.min(F.struct((-F.col("number")).alias("low"), "license")).alias("best")).select(
        F.col("dir").alias("from_dir"), F.col("best.license").alias("dir_license")), "license_dirs")
    dirs = rows.where("path is not null").select(_directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/", -1)
    above = dirs.select("dir", F.explode(F.transform(
        F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("from_dir")))).alias("up"))
    nearest = above.select("dir", "up.depth", "up.from_dir").join(holding, "from_dir").groupBy("dir").agg(
        F.max(F.struct("depth", "from_dir", "dir_license")).alias("best"))
    nearest = materialize(nearest.select("dir", "best.from_dir", "best.dir_license"), "nearest_dirs")
    without = rows.where(~F.coalesce(F.col("text").rlike(cue), F.lit(False))).select("path").unionByName(
        noted.join(own.select("row"), "row", "left_anti").select("path"))
    rest = without.withColumn("dir", _directory(F.col("path"))).join(nearest, "dir", "left").select(
        "path", F.col("dir_license").alias("license"), F.lit(None).cast("double").alias("score"),
        F.when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"), "from_dir")
    return own.select("path", "license", "score", "origin", F.lit(None).cast("string").alias("from_dir")).unionByName(rest)
