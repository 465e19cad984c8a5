import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlab.llm.lm_score import score_texts


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute(train, tests, depth, gain):
    """log10 of each text's probability, by dictionaries of contexts."""
    counts = [Counter() for _ in range(depth + 1)]
    for text in train:
        data = b"\n" * depth + " ".join(words(text)).encode() + b"\n"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                counts[d][data[i - d:i], data[i]] += 1
    total = sum(counts[0].values())
    alls = [Counter() for _ in range(depth + 1)]
    kinds = [Counter() for _ in range(depth + 1)]
    for d in range(depth + 1):
        for (context, _), n in counts[d].items():
            alls[d][context] += n
            kinds[d][context] += 1
    kept = set()
    for d in range(1, depth + 1):
        told = Counter()
        for (context, symbol), n in counts[d].items():
            up = counts[d - 1][context[1:], symbol] / alls[d - 1][context[1:]]
            told[context] += n * math.log(n / alls[d][context] / up)
        for context, g in told.items():
            if g >= gain * total and g > kinds[d][context]:
                kept.update(context[k:] for k in range(d))

    def share(context, symbol):
        if not context:
            return (counts[0][b"", symbol] + 0.5) / (total + 0.5 * 252)
        d = len(context)
        k = kinds[d][context]
        return (counts[d][context, symbol] + k * share(context[1:], symbol)) / (alls[d][context] + k)

    out = []
    for text in tests:
        data = b"\n" * depth + " ".join(words(text)).encode() + b"\n"
        score = 0.0
        for i in range(depth, len(data)):
            d = 0
            while d < depth and data[i - d - 1:i] in kept:
                d += 1
            score += math.log10(share(data[i - d:i], data[i]))
        out.append(score)
    return out


def rows():
    rng = random.Random(2)
    parts = ["th", "er", "on", "an", "re", "é", "ou"]
    made = [(k, " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60)))) for k in range(120)]
    return made + [(200, None), (201, ""), (202, "  \n\t"), (203, "THE The the\x0bthe"), (204, "zzz ÿ 漢字"), (3, made[3][1]), (None, made[4][1])]


@pytest.mark.parametrize("heads, depth, gain", [(1 << 19, 5, 1e-6), (5, 3, 1e-3), (0, 1, 1e-6)])
def test_against_brute_force(spark, heads, depth, gain):
    data = rows()
    docs = spark.createDataFrame([(k, t, k is not None and k % 4 == 1, 1.0, 2) for k, t in data],
                                 "doc_id long, text string, held boolean, score double, n int")
    flag = F.when(F.col("doc_id").isNotNull(), F.col("held"))
    made = score_texts(docs, flag, depth=depth, gain=gain, head_words=heads).collect()
    train = [t for k, t in data if k is not None and k % 4 != 1]
    counts = Counter(w for t in train for w in [*words(t), "\n"])
    total = sum(counts.values())
    bar = total + 0.5 * (len(counts) + 1)
    scores = brute(train, [t for _, t in data], depth, gain)
    want = []
    for (k, t), score in zip(data, scores):
        own = [*words(t), "\n"]
        want.append((k, k is not None and k % 4 == 1, len(own), sum(counts[w] > 0 for w in own), total,
                     sum(math.log10((counts[w] + 0.5) / bar) for w in own), score))
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(map(tuple, made), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)


def test_without_training_rows(spark):
    one = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    row = score_texts(one, F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (2, 0, 0)
    assert row.base_score == pytest.approx(0.0) and row.score == pytest.approx(-3 * math.log10(252), rel=1e-5)
    assert score_texts(one.limit(0), F.lit(False)).count() == 0
