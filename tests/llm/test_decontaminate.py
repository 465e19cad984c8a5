import random
import re

import pytest

from flowlab.llm.decontaminate import merge_spans, scan_benchmark

DOCS = "doc_id long, text string, n_words long, items string, spans int, doc string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    own, hit, found = words(text), set(), set()
    for key, item in items:
        theirs = words(item)
        wide = min(window, len(theirs))
        grams = {tuple(theirs[i:i + wide]) for i in range(len(theirs) - wide + 1)} if theirs and key is not None else set()
        for i in range(len(own) - wide + 1):
            if tuple(own[i:i + wide]) in grams:
                hit.update(range(i, i + wide))
                found.add(str(key))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("window, block", [(13, 200_000), (13, 40), (4, 200_000), (1, 200_000)])
def test_against_brute_force(spark, window, block):
    rng = random.Random(window)
    pool = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(pool, k=rng.choice([1, 2, 3, 5, 13, 14, 30])))) for k in range(40)]
    items += [(None, "w1 w2 w3"), (41, None), (42, " -- "), (7, "another text with id seven"), (43, items[3][1])]
    rows = []
    for k in range(60):
        text = rng.choices(pool, k=rng.randrange(60))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = words(rng.choice(items)[1])
        rows.append((k, "".join(w.upper() + rng.choice([" ", ", ", "\n", "-", " ... "]) for w in text)))
    rows += [(100, None), (101, ""), (102, "!!"), (3, rows[3][1]), (None, rows[4][1]), (103, " ".join(pool * 400)), (104, "É w1 é")]
    docs = spark.createDataFrame([(k, t, 5, "x", 1, "y") for k, t in rows], DOCS)
    made = scan_benchmark(docs, spark.createDataFrame(items, "item_id long, text string"), window, block_windows=block).collect()
    assert len(made) == len(rows)
    for r in made:
        assert (r.n_words, r.n_hit, sorted(r["items"])) == brute(r.doc.text, items, window)
        assert sum(s["end"] - s["first"] for s in r.spans) == r.n_hit
        assert (r.doc.n_words, r.doc["items"], r.doc.doc) == (5, "x", "y")


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{k} long, text string") for k in ("doc_id", "item_id"))
    full = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert scan_benchmark(docs, items).count() == 0
    row = scan_benchmark(full, items).first()
    assert (row.n_words, row.n_hit, row["items"]) == (2, 0, [])


def test_merge_spans():
    assert merge_spans([(5, 8), (1, 3), (3, 4), (7, 9)]) == [(1, 4), (5, 9)]
