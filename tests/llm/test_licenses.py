import math
from collections import Counter

import pytest

from flowlab.llm.licenses import TEMPLATES, Weights, scan_licenses, words_of

MIT, GPL, APACHE = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", \
    "Licensed under the Apache License, Version 2.0."
ROWS = [
    ("a/LICENSE", MIT), ("a/b/COPYING", "\n" + GPL + "\n"), ("a/b/c/x.py", "code without a notice"), ("a/y.py", None), ("a/z.py", ""),
    ("a/b/own.py", "words of code " * 40 + "\n// " + APACHE + "\nmore words"), ("top.py", "nothing"), ("abc/near.py", "not below a"), (None, "no path"),
    (None, MIT), ("q/one", MIT), ("q/two", GPL), ("q/three", GPL), ("q/rest", "the the the of"), ("q/rest", "the the the of"), ("r/one", MIT), ("r/two", GPL),
    ("r/x", "x"), ("a/b/long", "word " * 50_000), ("a/b/upper", "x " * 90 + "\nRELEASED UNDER THE MIT LICENSE\n" + APACHE), ("/abs/f", "x"), ("s/", "released by mit today"),
]


def cosine(text):
    weights, best = Weights(TEMPLATES), (0.0, "")
    bag = Counter(words_of(text))
    size = math.sqrt(sum((n * weights.idf.get(w, weights.other)) ** 2 for w, n in bag.items()))
    for k in range(len(TEMPLATES)):
        dot = sum(bag[w] * weights.idf[w] * x for w, t, _, x in weights.rows if t == k)
        score = round(dot / size, 6) if size else 0.0
        best = max(best, (score, TEMPLATES[k][0]), key=lambda b: (b[0], [-ord(c) for c in b[1]]))
    return best


def brute(rows):
    own = []
    for path, text in rows:
        whole = cosine(text or "")
        header = max((cosine(line) for line in (text or "").split("\n")), key=lambda b: (b[0], [-ord(c) for c in b[1]]))
        own.append(("file", *whole) if whole[0] >= 0.5 else ("header", *header) if header[0] >= 0.75 else None)
    held = {}
    for (path, _), o in zip(rows, own):
        if o and o[0] == "file" and path is not None:
            held.setdefault(path.rpartition("/")[0], Counter())[o[2]] += 1
    out = []
    for (path, _), o in zip(rows, own):
        if o:
            out.append((path, o[2], o[1], o[0], None))
            continue
        at = path.rpartition("/")[0] if path is not None else None
        while at is not None and at not in held:
            at = at.rpartition("/")[0] if at else None
        name = min(held[at].items(), key=lambda kv: (-kv[1], kv[0]))[0] if at is not None else None
        out.append((path, name, None, "inherited" if name else "none", at))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    files = spark.createDataFrame([(p, t, "x", 1, "y") for p, t in ROWS], "path string, text string, license string, row int, dir string")
    made = scan_licenses(files).collect()
    assert sorted(map(tuple, made), key=repr) == brute(ROWS)
    by = {r.path: r for r in made}
    assert by["a/b/c/x.py"].from_dir == "a/b" and by["a/y.py"].license == "MIT" and by["abc/near.py"].origin == "none"
    assert by["a/b/own.py"].license == "Apache-2.0" and by["q/rest"].license == "GPL-3.0" and by["r/x"].license == "GPL-3.0"


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.5, 0.75])
def test_no_similar_text_lacks_a_cue(least):
    weights = Weights(TEMPLATES)
    for _, text in TEMPLATES:
        without = " ".join(w for w in words_of(text) if w not in weights.cues(least))
        assert not without or cosine(without)[0] < 1.0
        number = [t for _, t in TEMPLATES].index(text)
        assert sum(x * x for w, t, _, x in weights.rows if t == number and w not in weights.cues(least)) < least * least
