from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlab.llm.token_counts import OUTSIDE, count_tokens, token_spans
from flowlab.llm.tokens import vocabulary


def offsets(text):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary())
    made.encode_special_tokens = True
    return made.encode(text, add_special_tokens=False).offsets


def brute(text, spans, rule):
    counts = Counter()
    for start, end in offsets(text):
        shared = {}
        for c in range(start, end):
            for k, (a, b) in enumerate(spans):
                if a <= c < b:
                    shared[k] = shared.get(k, 0) + 1
                    break
        if not shared:
            counts[OUTSIDE] += 1
        elif rule == "first":
            counts[min(shared)] += 1
        elif rule == "last":
            counts[max(shared)] += 1
        else:
            counts[max(shared, key=lambda k: (shared[k], -k))] += 1
    return counts


@given(st.text(alphabet="ab é漢🙂\n. ", max_size=40))
@settings(max_examples=60, deadline=None)
def test_spans_are_the_tokenizers(text):
    starts, ends = token_spans(text)
    assert list(zip(starts.tolist(), ends.tolist())) == offsets(text)


@pytest.mark.parametrize("rule", ["majority", "first", "last"])
def test_given_sections(spark, rule):
    text = "The quick brown fox jumps over the lazy dog, naïve 漢字🙂 and antidisestablishmentarianism."
    spans = [(0, 7), (7, 13), (13, 14), (14, 14), (20, 22), (22, 51), (51, 53), (60, 75)]
    rows = [(1, text, spans), (2, text, [(60, 75), None, (0, 7), (None, 3), (5, 9)]), (3, None, []), (4, "x", None), (5, "", [(0, 9)]), (1, text, spans)]
    docs = spark.createDataFrame([(*r, 0, "y") for r in rows], "doc_id long, text string, parts array<struct<first:long,end:long>>, section int, end string")
    made = count_tokens(docs, "parts", rule).collect()
    own = [r for r in made if r.doc_id == 1]
    want = brute(text, spans, rule)
    assert Counter({r.section: r.n_tokens for r in own if r.n_tokens}) == want and len(own) == 2 * (len(spans) + 1)
    two = {r.section: r for r in made if r.doc_id == 2}
    assert [(two[k].first, two[k].end) for k in range(3)] == [(0, 7), (7, 9), (60, 75)]
    assert {k: r.n_tokens for k, r in two.items() if r.n_tokens} == brute(text, [(0, 7), (7, 9), (60, 75)], rule)
    assert [(r.section, r.n_tokens) for r in made if r.doc_id == 3] == [(OUTSIDE, 0)]
    assert [(r.section, r.n_tokens) for r in made if r.doc_id == 4] == [(OUTSIDE, 1)]
    assert [(r.section, r.n_tokens, r.end) for r in made if r.doc_id == 5] == [(0, 0, 0)]


def test_lines(spark):
    rows = [(1, "one two\n\nthree\n"), (2, "no end"), (3, ""), (None, None), (4, "\n\n\n\nx"), (5, "word " * 20_000 + "\n" + "é" * 5_000)]
    made = count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for key, text in rows:
        own = sorted((r for r in made if r.doc_id == key), key=lambda r: r.section)
        lines = (text or "").splitlines(keepends=True) or [""]
        assert "".join((text or "")[r.first:r.end] for r in own) == (text or "") and len(own) == len(lines)
        assert sum(r.n_tokens for r in own) == own[0].doc_tokens == len(offsets(text or ""))
    four = {r.section: r for r in made if r.doc_id == 4}
    assert four[0].n_crossing == 1 or four[0].n_tokens == 1
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), rule="other")
