import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.llm.ann import Tree, nearest_vectors

SCHEMA = "vec_id long, embedding array<float>, rank string, leaf int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, queries, number):
    kept = {k: np.array(v, dtype=np.float32).astype(float) for k, v in rows if usable(v) and k is not None}
    out = {}
    for q in queries:
        if q in kept:
            near = sorted((-float(np.add.reduce(kept[q] * v)), k) for k, v in kept.items() if k != q)[:number]
            out[q] = [(k, -s) for s, k in near]
    return out


def test_all_candidates_are_found_when_few(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(40)]
    rows += [(k, [1.0] * 8) for k in range(100, 110)]  # ties
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8),
             (204, [float("inf")] * 8), (205, [1.0, 2.0]), (None, [1.0] * 8), (206, [])]
    rows += [rows[0]]
    made = nearest_vectors(frame(spark, rows), F.col("vec_id") % 20 == 0, 12, recall=1.0).collect()
    got = {}
    for r in sorted(made, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute(rows, range(0, 300, 20), 12)
    assert set(got) == set(want)
    for q in want:
        assert [k for k, _ in got[q]] == [k for k, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    points = centres[rng.integers(0, 20, 3_000)] + rng.normal(0, 0.4, (3_000, 8))
    points *= rng.uniform(0.5, 2, (3_000, 1)) if scaled else 1
    rows = [(k, p.astype(np.float32).tolist()) for k, p in enumerate(points)]
    made = nearest_vectors(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, sample_rows=1_500, calibration_queries=60).collect()
    want = brute(rows, range(0, 3_000, 20), 20)
    found = {}
    for r in made:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(made) == 150 * 20
    assert np.mean([len(found[q] & {k for k, _ in near}) / 20 for q, near in want.items()]) >= 0.9


def test_crowded_leaf(spark):
    rows = [(k, [1.0, 0.5] + [0.0] * 6) for k in range(9_000)]
    made = nearest_vectors(frame(spark, rows), F.col("vec_id") % 3_000 == 0, 5).collect()
    assert {(r.query_id, r["rank"]): r.vec_id for r in made} == {
        (q, k + 1): v for q in (0, 3_000, 6_000) for k, v in enumerate([1, 2, 3, 4, 5] if q == 0 else [0, 1, 2, 3, 4])}


def test_empty_tables(spark):
    assert nearest_vectors(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest_vectors(frame(spark, [(0, [1.0] * 8)]), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest_vectors(frame(spark, [(1, [1.0] * 8), (2, [2.0] * 8)]), F.col("vec_id") % 20 == 0).count() == 0


def test_best_bins_reach_every_leaf():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(600, 5))
    tree = Tree(points, leaf_rows=20)
    assert sorted(tree.best_bins(points[0], tree.leaves)) == list(range(tree.leaves))
    assert [tree.best_bins(p, 1)[0] for p in points[:50]] == tree.leaf_of(points[:50]).tolist()
