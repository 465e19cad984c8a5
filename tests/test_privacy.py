import json
import random

import pytest
from pyspark.sql import functions as F

from flowlab.operators import privacy


def epsilon(spark, n, sigma, epochs, rounds=40):
    clients = spark.createDataFrame([(0, n, sigma, 1e-5, True)], "client_id int, n bigint, sigma double, delta double, dp_enabled boolean")
    got = privacy.privacy_ledger(clients, rounds, epochs)
    return {r["server_round"]: r["epsilon"] for r in got.collect()}


# fixed values: budgets published for these settings
@pytest.mark.parametrize("n,sigma,epochs,published,tolerance", [
    (18_357, 1.1, 1, 1.263, 0.001),
    (35_000, 1.1, 1, 0.912, 0.001),
    (7_342, 1.1, 2, 3.071, 0.002),
    (35_000, 0.8, 2, 2.412, 0.002),
    (35_000, 0.5, 2, 12.554, 0.004),
    (35_000, 0.3, 2, 139.484, 0.01),
])
def test_published_budgets(spark, n, sigma, epochs, published, tolerance):
    assert epsilon(spark, n, sigma, epochs)[40] == pytest.approx(published, abs=tolerance)


def test_budget_grows_with_rounds_and_falls_with_noise(spark):
    low, high = epsilon(spark, 5000, 1.1, 1, rounds=10), epsilon(spark, 5000, 2.0, 1, rounds=10)
    assert all(low[i] < low[i + 1] for i in range(1, 10))
    assert all(high[i] < low[i] for i in range(1, 11))


def test_switched_off_and_whole_batch(spark):
    clients = spark.createDataFrame(
        [(0, 100, 1.1, 1e-5, False), (1, 0, 1.1, 1e-5, True), (2, 32, 1.5, 1e-5, True), (3, 20, 1.1, 1e-5, True),
         (4, 64, 0.0, 1e-5, True)],
        "client_id int, n bigint, sigma double, delta double, dp_enabled boolean",
    )
    got = {r["client_id"]: r for r in privacy.privacy_ledger(clients, 1).collect()}
    assert got[0]["epsilon"] == got[1]["epsilon"] == -1.0
    assert got[2]["steps"] == 1 and got[2]["epsilon"] > 0
    assert (got[3]["steps"], got[3]["epsilon"]) == (0, 0.0) and got[4]["epsilon"] == float("inf")
    whole = {r["client_id"]: r["steps"] for r in privacy.privacy_ledger(clients, 1, 2, batch=None).collect()}
    assert whole == {0: 2, 1: 0, 2: 2, 3: 2, 4: 2}


def test_large_orders_help_large_clients(spark):
    # with orders up to 64 only, the conversion alone would cost about 0.1
    assert epsilon(spark, 50_000_000, 30.0, 1, rounds=1)[1] < 0.05


def test_noisy_mean(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.array(F.lit(3.0), F.lit(4.0)).alias("v"))
    plain = privacy.dp_vector_mean(rows, ["g"], "v", clip=1.0, sigma=0.0, seed=1).collect()
    assert all(r["v"] == pytest.approx([0.6, 0.8]) for r in plain)
    noisy = [privacy.dp_vector_mean(rows.repartition(p), ["g"], "v", clip=1.0, sigma=5.0, seed=1).orderBy("g").collect() for p in (1, 8)]
    for a, b in zip(*noisy):
        assert a["v"] == pytest.approx(b["v"]) and a["v"] != pytest.approx([0.6, 0.8], abs=1e-6)


def test_noise_is_standard_normal(spark):
    got = spark.range(50_000).select(privacy.hash_gaussian(3, F.col("id")).alias("z")).agg(
        F.avg("z"), F.stddev("z"), F.avg((F.abs("z") < 1.96).cast("double"))
    ).first()
    assert abs(got[0]) < 0.02 and abs(got[1] - 1) < 0.02 and abs(got[2] - 0.95) < 0.01


def sealed(spark, text):
    rows = spark.createDataFrame([(1, text), (2, text)], "server_round int, body string")
    secret = spark.createDataFrame([("s3cret",)], "secret string")
    key = privacy.round_key(secret, F.col("server_round"))
    return secret, key, privacy.seal(rows, "body", key)


@pytest.mark.parametrize("payload", [
    [random.Random(0).random() for _ in range(500)],
    [[1.5, -2.25], [], [1e300, 7e-9, 0.0]],
])
def test_seal_and_open(spark, payload):
    text = json.dumps(payload)
    _, key, closed = sealed(spark, text)
    row = closed.first()
    assert len(row["sealed"]) == row["plain_bytes"] + 28 and text.encode() not in bytes(row["sealed"])
    opened = privacy.open_sealed(closed, "sealed", key).collect()
    assert all(json.loads(bytes(r["plain"])) == payload for r in opened)


def test_wrong_round_retired_key_and_changed_body_stay_closed(spark):
    secret, key, closed = sealed(spark, "hello")
    swapped = closed.withColumn("server_round", 3 - F.col("server_round"))
    assert privacy.open_sealed(swapped, "sealed", key).filter("plain is not null").count() == 0
    later = privacy.open_sealed(closed, "sealed", privacy.round_key(secret, F.col("server_round"), keep_from=2))
    assert {r["server_round"]: r["plain"] is None for r in later.collect()} == {1: True, 2: False}
    changed = closed.withColumn("sealed", F.concat(F.col("sealed"), F.lit(b"x")))
    assert privacy.open_sealed(changed, "sealed", key).filter("plain is not null").count() == 0
    lost = closed.withColumn("server_round", F.lit(None).cast("int"))
    assert privacy.open_sealed(lost, "sealed", key).filter("plain is not null").count() == 0


def test_payloads_are_scanned_once_without_a_join(spark, tmp_path):
    path = str(tmp_path / "payloads")
    spark.range(10).select("id", F.lit(1).alias("server_round"), F.lit("x").alias("body")).write.parquet(path)
    spark.range(1).select(F.lit("s3cret").alias("secret")).write.parquet(str(tmp_path / "secret"))
    key = privacy.round_key(spark.read.parquet(str(tmp_path / "secret")), F.col("server_round"))
    opened = privacy.open_sealed(privacy.seal(spark.read.parquet(path), "body", key), "sealed", key)
    text = opened._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("payloads") <= 1 and "Join" not in text and "s3cret" not in text
    assert opened.filter("cast(plain as string) = 'x'").count() == 10
