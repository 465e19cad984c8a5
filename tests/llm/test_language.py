import random
from collections import Counter

import numpy as np

from flowlab.llm.language import FEATURE_BITS, cluster, counts_of, fit, grams, identify

SAMPLES = {
    "en": "the and of to in is that for with was on are this from they have which",
    "de": "der die und das nicht mit ein eine ist auf dem auch werden über für können",
    "fr": "le la les des et une pour que dans est pas sur avec être où même très",
}


def rows(number, seed):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(SAMPLES[lang].split(), k=40)), lang) for k in range(number) for lang in SAMPLES]


def test_held_out_accuracy_and_rejection(spark):
    train = rows(60, 1) + [(0, None, "en"), (1, "ohne sprache", None), (2, "12 34", "de")]
    model = fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 !! 34", "en"), (903, "漢字漢字漢字", "en"), (None, "the and of", "en")]
    test = rows(30, 2) + odd
    docs = spark.createDataFrame([(k, t, la, 1.0, "z") for k, t, la in test], "doc_id long, text string, lang string, score double, accepted string")
    made = identify(docs, model).collect()
    assert len(made) == len(test)
    known = [r for r in made if r.doc.doc_id is not None and r.doc.doc_id < 900]
    assert np.mean([r.lang_pred == r.doc.lang for r in known]) > 0.99 and all(r.accepted for r in known)
    by = {r.doc.doc_id: r for r in made}
    for k in (900, 901, 902):
        assert (by[k].lang_pred, by[k].score, by[k].accepted) == ("und", 0.0, False)
    assert by[903].lang_pred in SAMPLES and not by[903].accepted
    assert all(0 <= r.score <= 1 for r in made) and by[900].doc.accepted == "z"


def test_without_labelled_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = fit(empty)
    assert identify(empty, model).count() == 0
    one = spark.createDataFrame([(1, "word", "en"), (2, "7", "en")], "doc_id long, text string, lang string")
    assert {(r.doc.doc_id, r.lang_pred, r.accepted) for r in identify(one, model).collect()} == {(1, "und", True), (2, "und", False)}


def plain_grams(text):
    out = Counter()
    for word in "".join(c.lower()[0] if c.isalpha() else " " for c in text).split():
        word = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(word) - n + 1):
                if word[i:i + n] != " ":
                    out[word[i:i + n]] += 1
    return out


def test_grams_are_those_of_the_words():
    for text in ("", "a", "Ab, c!", "  Héllo  wörld 12x ", "漢 字"):
        assert len(grams(text)) == sum(plain_grams(text).values())
        number = len(plain_grams(text))
        assert len(set(grams(text).tolist())) in (number, number - 1)  # at most one chance collision here


def test_pieces_do_not_change_counts():
    text = "Über 12 die  Brücke, and back. " * 50
    assert (counts_of(text) == counts_of(text, piece=7)).all() and len(counts_of(None)) == 1 << FEATURE_BITS


def test_cluster_finds_separate_directions():
    rng = np.random.default_rng(0)
    points = np.repeat(np.eye(3, 8), 30, axis=0) + rng.normal(0, 0.02, (90, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    assert sorted(np.argmax(cluster(points, 3), axis=1)) == [0, 1, 2]
    assert len(cluster(points[:1].repeat(5, axis=0), 3)) == 1
