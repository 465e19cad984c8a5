import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import learn, metrics, privacy
from flowlab.sources.telemetry import TELEMETRY


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(900):
        y = i % 3
        x = rng.normal(size=2) + [(0, 0), (4, 0), (0, 4)][y]
        data.append((i, int(i % 10 < 3), y, float(x[0]), float(x[1])))
    return spark.createDataFrame(data, "id bigint, client_id int, label int, a double, b double")


def trained(spark, rows, **kw):
    shards = learn.prepare_shards(rows, ["a", "b"], "label", "id", kw.pop("shards", 1))
    got = learn.local_update(shards, learn.initial_weights(2, 3), 3, **kw)
    return {r["client_id"]: r for r in got.collect()}


def test_full_batch_step_matches_brute_force(spark, rows):
    pdf = rows.toPandas()
    for shards in (1, 5):
        got = trained(spark, rows, epochs=1, rate=0.5, batch=None, shards=shards)
        for client, part in pdf.groupby("client_id"):
            x = np.column_stack([part[["a", "b"]], np.ones(len(part))])
            y = np.eye(3)[part["label"]]
            step = -0.5 * (np.full_like(y, 1 / 3) - y).T @ x / len(part)
            assert got[client]["weights"] == pytest.approx(step.ravel().tolist())
            assert got[client]["num_examples"] == len(part)


def test_proximal_term_pulls_towards_the_start(spark, rows):
    free, held = trained(spark, rows, epochs=3), trained(spark, rows, epochs=3, mu=5.0)
    for client in free:
        assert np.linalg.norm(held[client]["weights"]) < np.linalg.norm(free[client]["weights"])


def test_shards_are_those_asked_for(spark, rows):
    shards = learn.prepare_shards(rows, ["a", "b"], "label", "id", shards=5)
    sizes = [r["count"] for r in shards.groupBy("client_id", "shard").count().collect()]
    assert sum(sizes) == 900 and len(sizes) == 10


def sequential(x, y, w, epochs, rate, batch):
    """The plain loop over whole mini-batches."""
    for _ in range(epochs):
        for at in range(0, len(x) - batch + 1, batch):
            xb, yb = x[at:at + batch], y[at:at + batch]
            p = np.exp(xb @ w.T - (xb @ w.T).max(axis=1, keepdims=True))
            w = w - rate * (p / p.sum(axis=1, keepdims=True) - yb).T @ xb / batch
    return w


@pytest.mark.parametrize("n", [20, 120_000])
def test_a_client_of_any_size_trains_like_the_plain_loop(spark, n):
    table = spark.range(n).select(
        "id", F.lit(7).alias("client_id"), (F.col("id") % 3).cast("int").alias("label"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 500.0 - 1).alias("a"), (F.col("id") % 3 / 2.0).alias("b"))
    got = trained(spark, table, epochs=1, rate=0.1, batch=32)[7]
    data = sorted((hashlib.md5(f"order:{r.id}".encode()).hexdigest(), r.a, r.b, r.label) for r in table.collect())
    x = np.array([(a, b, 1.0) for _, a, b, _ in data])
    want = sequential(x, np.eye(3)[[r[3] for r in data]], np.zeros((3, 3)), 1, 0.1, 32)
    assert got["weights"] == pytest.approx(want.ravel().tolist(), abs=1e-9) and got["num_examples"] == n
    assert (got["loss"] is None) == (n < 32)


def test_rounds_learn_and_log(spark, rows):
    weights, log = learn.federated_fit(rows, ["a", "b"], "label", 3, "id", rounds=3)
    assert log.columns == list(TELEMETRY) and len(weights) == 9
    joint = {r["server_round"]: r for r in log.filter("client_id = 'aggregate'").collect()}
    assert joint[3]["global_accuracy"] > 0.9 and joint[3]["global_loss"] < joint[1]["global_loss"]
    kinds = log.groupBy("server_round").count().collect()
    assert {r["count"] for r in kinds} == {5}
    own = log.filter("eval_client_id <> 'aggregate' and server_round = 3").collect()
    assert {r["global_accuracy"] for r in own} == {joint[3]["global_accuracy"]}


def test_private_rounds(spark, rows):
    secret = spark.createDataFrame([("s3cret",)], "secret string")
    noise = learn.Noise(learn.secret_seed(secret), sigma=2.0)
    plain, _ = learn.federated_fit(rows, ["a", "b"], "label", 3, "id", rounds=2)
    noisy, log = learn.federated_fit(rows, ["a", "b"], "label", 3, "id", rounds=2, noise=noise, test=0.2)
    again, _ = learn.federated_fit(rows.repartition(5), ["a", "b"], "label", 3, "id", rounds=2, noise=noise, test=0.2)
    assert noisy == pytest.approx(again) and noisy != pytest.approx(plain, rel=1e-3)
    spent = {(r["client_id"], r["server_round"]): r["epsilon_consumed"] for r in log.filter("dp_enabled").collect()}
    assert len(spent) == 4 and spent["0", 2] > spent["0", 1] > 0


def test_budget_is_that_of_what_is_trained(spark, rows):
    def spent(shards):
        _, log = learn.federated_fit(rows, ["a", "b"], "label", 3, "id", rounds=1, noise=learn.Noise(5), shards=shards)
        return {r["client_id"]: r["epsilon_consumed"] for r in log.filter("dp_enabled").collect()}

    shards = learn.prepare_shards(rows, ["a", "b"], "label", "id", 3).groupBy("client_id", "shard").agg(F.count("*").alias("n"))
    plan = shards.withColumns({"sigma": F.lit(1.1), "delta": F.lit(1e-5), "dp_enabled": F.lit(True)})
    each = {}
    for r in privacy.privacy_ledger(plan.withColumn("client_id", F.struct("client_id", "shard")), 1, 2).collect():
        key = str(r["client_id"]["client_id"])
        each[key] = max(each.get(key, 0), r["epsilon"])
    assert spent(3) == pytest.approx(each) and all(spent(1)[k] < each[k] for k in each)


def test_clipping_bounds_a_step(spark, rows):
    loud = rows.withColumn("a", F.col("a") * 1000)
    held = trained(spark, loud, epochs=1, rate=1.0, batch=None, noise=learn.Noise(0, sigma=0.0, clip=0.5))
    assert all(np.linalg.norm(r["weights"]) <= 0.5 + 1e-9 for r in held.values())


def test_evaluation(spark, rows):
    w = np.arange(9).reshape(3, 3) / 5 - 0.7
    got = {r["client_id"]: r for r in learn.evaluate_clients(
        rows.withColumn("x", F.array("a", "b")), w.ravel().tolist(), 3, 2).collect()}
    for client, part in rows.toPandas().groupby("client_id"):
        s = np.column_stack([part[["a", "b"]], np.ones(len(part))]) @ w.T
        loss = np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(part)), part["label"]]
        assert got[client]["loss"] == pytest.approx(loss.mean())
        assert got[client]["accuracy"] == pytest.approx((s.argmax(axis=1) == part["label"]).mean())


@pytest.mark.parametrize("hidden", [None, [4]])
def test_baseline(spark, rows, hidden, tmp_path):
    binary = rows.withColumn("label", (F.col("label") > 0).cast("int"))
    scores = learn.fit_baseline(binary, ["a", "b"], "label", "id", hidden=hidden, save_to=str(tmp_path / "model"))
    assert scores.count() == 180
    assert metrics.roc_auc(scores).first()["auc"] > 0.95


def plain_full_batch(x, y, w, anchor, epochs, rate, mu, clip):
    """Full-batch steps by a plain loop, clipped example gradients, proximal term."""
    for _ in range(epochs):
        s = x @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        error = p / p.sum(axis=1, keepdims=True) - y
        if clip > 0:
            length = np.linalg.norm(error, axis=1) * np.linalg.norm(x, axis=1)
            error = error / np.maximum(1.0, length / clip)[:, None]
        w = w - rate * (error.T @ x / len(x) + mu * (w - anchor))
    return w


def test_a_hot_client_trains_over_many_partitions(spark, rows):
    # nine of ten rows belong to client 0, dealt over six partitions
    hot = rows.withColumn("client_id", (F.col("id") % 10 == 9).cast("int")).repartition(6)
    shards = learn.prepare_shards(hot, ["a", "b"], "label", "id")
    start = [0.1 * k for k in range(9)]
    partial = shards.select("client_id", "shard", "label", "x").mapInPandas(
        learn._partial_gradients({}, start, 3, 0.7), learn.PARTIAL)
    assert partial.where("client_id = 0").count() == 6
    got = {r["client_id"]: r for r in learn.full_batch_update(
        shards, start, 3, epochs=3, rate=0.4, mu=0.2, noise=learn.Noise(1, sigma=0.0, clip=0.7)).collect()}
    pdf = hot.toPandas()
    for client, part in pdf.groupby("client_id"):
        x = np.column_stack([part[["a", "b"]], np.ones(len(part))])
        anchor = np.asarray(start).reshape(3, 3)
        want = plain_full_batch(x, np.eye(3)[part["label"]], anchor, anchor, 3, 0.4, 0.2, 0.7)
        assert got[client]["weights"] == pytest.approx(want.ravel().tolist())
        assert got[client]["num_examples"] == len(part)


@pytest.fixture(scope="module")
def gappy(spark):
    """Rows in two of nine partitions, as of a file cut into more parts than it has row groups."""
    table = spark.range(0, 900, 1, 9).filter("id < 200").select(
        "id", (F.col("id") % 7 % 2).cast("int").alias("client_id"), (F.col("id") % 3).cast("int").alias("label"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 500.0 - 1).alias("a"), (F.col("id") % 3 / 2.0).alias("b"))
    assert table.select(F.spark_partition_id()).distinct().count() == 2 and table.rdd.getNumPartitions() == 9
    return table


def plain_rounds(pdf, rounds, epochs, rate, mu=0.0, clip=0.0):
    """Federated rounds by a plain loop over clients: full-batch steps, mean weighted by rows."""
    w = np.zeros((3, 3))
    for _ in range(rounds):
        total = np.zeros_like(w)
        for _, part in pdf.groupby("client_id"):
            x = np.column_stack([part[["a", "b"]], np.ones(len(part))])
            total += len(part) * plain_full_batch(x, np.eye(3)[part["label"]], w, w, epochs, rate, mu, clip)
        w = total / len(pdf)
    return w.ravel().tolist()


def test_rounds_pass_partitions_without_rows(gappy):
    weights, log = learn.federated_fit(gappy, ["a", "b"], "label", 3, "id", rounds=3, epochs=1, rate=0.5, batch=None)
    assert weights == pytest.approx(plain_rounds(gappy.toPandas(), 3, 1, 0.5))
    assert log.count() == 3 * 5


def test_proximal_rounds_pass_partitions_without_rows(gappy):
    weights, log = learn.federated_fit(
        gappy, ["a", "b"], "label", 3, "id", rounds=2, epochs=2, rate=0.5, batch=None, mu=0.1)
    assert weights == pytest.approx(plain_rounds(gappy.toPandas(), 2, 2, 0.5, mu=0.1))
    assert log.count() == 2 * 5


def test_one_update_passes_partitions_without_rows(spark, gappy):
    got = trained(spark, gappy, epochs=1, rate=0.5, batch=None)
    for client, part in gappy.toPandas().groupby("client_id"):
        assert got[client]["weights"] == pytest.approx(plain_rounds(part, 1, 1, 0.5))
        assert got[client]["num_examples"] == len(part)


def test_private_rounds_pass_partitions_without_rows(gappy):
    weights, log = learn.federated_fit(
        gappy, ["a", "b"], "label", 3, "id", rounds=2, epochs=1, rate=0.5, batch=None,
        noise=learn.Noise(1, sigma=0.0, clip=0.7), test=0.2)
    kept = learn.stratified_split(gappy, "label", 0.2, ["id"]).filter("not is_test").toPandas()
    assert weights == pytest.approx(plain_rounds(kept, 2, 1, 0.5, clip=0.7)) and len(kept) == 158
    assert log.count() == 2 * 5


def test_minibatches_stream_across_small_arrow_batches(spark):
    table = spark.range(2_000).select(
        "id", F.lit(3).alias("client_id"), (F.col("id") % 3).cast("int").alias("label"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 500.0 - 1).alias("a"), (F.col("id") % 3 / 2.0).alias("b"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "45")  # mini-batches straddle Arrow batches
    try:
        noise = learn.Noise(11, sigma=0.3, clip=0.8)
        got = trained(spark, table, epochs=2, rate=0.1, batch=32, mu=0.05, noise=noise, number=4)[3]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    data = sorted((hashlib.md5(f"order:{r.id}".encode()).hexdigest(), r.a, r.b, r.label) for r in table.collect())
    x = np.array([(a, b, 1.0) for _, a, b, _ in data])
    y = np.eye(3)[[r[3] for r in data]]
    w = anchor = np.zeros((3, 3))
    draw = np.random.default_rng([11, 4, 3, 0])
    for _ in range(2):
        for at in range(0, len(x) - 31, 32):
            xb, yb = x[at:at + 32], y[at:at + 32]
            s = xb @ w.T
            p = np.exp(s - s.max(axis=1, keepdims=True))
            error = p / p.sum(axis=1, keepdims=True) - yb
            length = np.linalg.norm(error, axis=1) * np.linalg.norm(xb, axis=1)
            error = error / np.maximum(1.0, length / 0.8)[:, None]
            step = error.T @ xb + draw.normal(0.0, 0.3 * 0.8, (3, 3))
            w = w - 0.1 * (step / 32 + 0.05 * (w - anchor))
    assert got["weights"] == pytest.approx(w.ravel().tolist(), abs=1e-9) and got["num_examples"] == 2_000


def test_tasks_need_no_package_on_the_executors(tmp_path):
    """What full-batch steps send to tasks loads where ``flowlab`` cannot be imported."""
    import pickle
    import subprocess
    import sys

    from pyspark import cloudpickle

    partial = learn._partial_gradients({}, [0.0] * 4, 2, 0.0)
    sent = tmp_path / "sent"
    sent.write_bytes(cloudpickle.dumps((partial, learn._merge_partials(), learn._stream_trainer({}, [0.0] * 4, 2, 0.1, 1, 0.0, None, 1, {}))))
    assert pickle.loads(sent.read_bytes())
    code = f"import pickle; assert len(pickle.load(open({str(sent)!r}, 'rb'))) == 3"
    made = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert made.returncode == 0, made.stderr
