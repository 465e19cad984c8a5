import itertools
import random

import pytest
from pyspark.sql import functions as F

from flowlab.operators import metrics
from flowlab.sources.telemetry import TELEMETRY, to_telemetry


def vectors(spark):
    return spark.createDataFrame(
        [("a", [1.0, 2.0, 3.0], 1), ("a", [3.0, 6.0, 9.0], 3), ("b", [5.0, 5.0, 5.0], 7)], "g string, w array<double>, n int"
    )


def test_weighted_vector_mean(spark):
    got = {r["g"]: r["w"] for r in metrics.weighted_vector_mean(vectors(spark), ["g"], "w", "n").collect()}
    assert got["a"] == pytest.approx([2.5, 5.0, 7.5]) and got["b"] == [5.0, 5.0, 5.0]
    equal = metrics.weighted_vector_mean(vectors(spark).withColumn("n", F.lit(1)), ["g"], "w", "n")
    assert equal.filter("g = 'a'").first()["w"] == pytest.approx([2.0, 4.0, 6.0])


def test_weighted_metrics_count_missing_accuracy_as_zero(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.5, 1), (1, 3.0, None, 3)], "r int, loss double, accuracy double, num_examples int")
    got = metrics.weighted_metrics(rows, ["r"]).first()
    assert (got["global_loss"], got["global_accuracy"], got["num_examples"]) == (2.5, 0.125, 4)


def test_class_distribution_and_ratio(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "c string")
    got = {r["c"]: (r["rows"], r["percent"]) for r in metrics.class_distribution(rows, "c").collect()}
    assert got == {"a": (3, 75.0), "b": (1, 25.0)}
    assert tuple(metrics.attack_ratio(rows, F.col("c") == "b").first()) == (1, 3, 25.0)
    assert tuple(metrics.attack_ratio(rows.limit(0), F.col("c") == "b").first()) == (0, 0, None)


def telemetry(spark, rows):
    names = list(TELEMETRY)
    filled = [{**dict.fromkeys(names, ""), **r} for r in rows]
    return spark.createDataFrame([tuple(str(r[n]) for n in names) for r in filled], ", ".join(f"{n} string" for n in names))


def runs(spark):
    rows = []
    for run, final in ((1, 5), (2, 4)):
        for rnd in range(1, final + 1):
            base = {"condition": "C_pqc_dp", "run": run, "server_round": rnd}
            rows += [
                {**base, "client_id": 0, "train_time_ms": 10 * run + rnd, "epsilon_consumed": rnd / 10},
                {**base, "client_id": 1, "train_time_ms": "oops", "epsilon_consumed": rnd / 5},
                {**base, "client_id": "aggregate", "global_loss": 1 / rnd, "global_accuracy": rnd / 10 + run,
                 "eval_client_id": "aggregate", "eval_accuracy": 9},
                {**base, "client_id": 0, "eval_client_id": "x", "eval_accuracy": 0.5},
            ]
    rows.append({"condition": "A_baseline", "run": 1, "server_round": 1, "client_id": 0, "train_time_ms": 7, "epsilon_consumed": -1.0})
    rows.append({"condition": "A_baseline", "run": 1, "server_round": "bad", "client_id": 0, "train_time_ms": 1000})
    return telemetry(spark, rows)


def test_summary(spark):
    got = {(r["condition"], r["metric"]): r for r in metrics.summarise_experiments(runs(spark)).collect()}
    times = [11, 12, 13, 14, 15, 21, 22, 23, 24]
    assert got["C_pqc_dp", "train_time_ms"]["n"] == 9
    assert got["C_pqc_dp", "train_time_ms"]["mean"] == pytest.approx(sum(times) / 9)
    # final round of each run; the larger budget where clients differ
    assert got["C_pqc_dp", "epsilon_consumed"]["mean"] == pytest.approx((1.0 + 0.8) / 2)
    assert got["C_pqc_dp", "global_accuracy"]["mean"] == pytest.approx((1.5 + 2.4) / 2)
    assert got["C_pqc_dp", "eval_accuracy"]["mean"] == 0.5
    assert ("A_baseline", "epsilon_consumed") not in got
    assert got["A_baseline", "train_time_ms"]["mean"] == 7 and got["A_baseline", "train_time_ms"]["std"] is None
    literal = {(r["condition"], r["metric"]): r["mean"] for r in metrics.summarise_experiments(runs(spark), True).collect()}
    assert literal["C_pqc_dp", "eval_accuracy"] == pytest.approx((0.5 + 9) / 2)


def test_convergence(spark):
    got = {r["server_round"]: r for r in metrics.convergence(runs(spark)).collect()}
    assert got[1]["mean"] == pytest.approx(1.6) and got[1]["std"] == pytest.approx(0.5**0.5)
    assert got[5]["std"] == 0.0 and got[5]["low"] == got[5]["high"] == pytest.approx(1.5)


def test_overhead(spark):
    rows = spark.createDataFrame([("a", 2.0, 0.0), ("a", 4.0, 0.0), ("b", 6.0, 1.0)], "condition string, x double, y double")
    got = {r["metric"]: r["overhead_percent"] for r in metrics.overhead_pct(rows, "a", "b", ["x", "y"]).collect()}
    assert got == {"x": 100.0, "y": None}


def test_scores(spark):
    rng = random.Random(1)
    data = [(rng.random() < 0.3, rng.randint(0, 20) / 20) for _ in range(400)]
    rows = spark.createDataFrame([(int(a), b) for a, b in data], "label int, score double")
    got = metrics.binary_metrics(rows).first()
    tp = sum(a and b > 0.5 for a, b in data)
    fp = sum(not a and b > 0.5 for a, b in data)
    assert (got["tp"], got["fp"], got["tp"] + got["fp"] + got["fn"] + got["tn"]) == (tp, fp, 400)
    assert got["precision"] == pytest.approx(tp / (tp + fp))
    pos, neg = [b for a, b in data if a], [b for a, b in data if not a]
    pairs = [1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg)]
    area = metrics.roc_auc(rows).first()
    assert area["auc"] == pytest.approx(sum(pairs) / len(pairs)) and area["positives"] == len(pos)


def test_valid_payloads_and_sizes(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["a", None, "c"]), (4, None)], "id int, parts array<string>")
    assert [r["id"] for r in metrics.valid_payloads(rows).collect()] == [1]
    sizes = spark.createDataFrame([(1, b"ab", b"abcd"), (1, b"", b"xx")], "r int, plain binary, sealed binary")
    assert tuple(metrics.payload_stats(sizes, ["r"]).first()) == (1, 2, 2, 6, 4)


def test_telemetry_columns(spark):
    assert to_telemetry(runs(spark)).columns == list(TELEMETRY) and len(TELEMETRY) == 18


def test_vector_sums_send_blocks_not_elements(spark, monkeypatch):
    monkeypatch.setattr(metrics, "VECTOR_BLOCK", 4)
    rng = random.Random(3)
    data = [(g, [rng.choice([None, rng.random()]) for _ in range(rng.randint(0, 10))], rng.choice([None, 1, 2, 5]))
            for g in ("a", "b", None) for _ in range(40)]
    data.append(("a", [1.0] * 10, 3))
    rows = spark.createDataFrame(data, "g string, v array<double>, n int").repartition(3)
    staged = rows.select("g", F.col("v").alias("_v"), F.col("n").cast("double").alias("_w"))
    parts = staged.mapInPandas(metrics._vector_partials(["g"]), "g string, " + metrics._PARTS).collect()
    assert 3 * 3 <= len(parts) <= 3 * 3 * 3  # at most groups x partitions x blocks of four positions
    got = {r["g"]: r["v"] for r in metrics.weighted_vector_mean(rows, ["g"], "v", "n").collect()}
    for g in ("a", "b", None):
        want = []
        for pos in range(10):
            held = [(v[pos], n) for k, v, n in data if k == g and len(v) > pos and v[pos] is not None]
            if held:
                weight = sum(n for _, n in held if n is not None)
                want.append(sum(x * n for x, n in held if n is not None) / weight if weight else None)
        assert got[g] == pytest.approx(want)
