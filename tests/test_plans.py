import pytest
from pyspark.sql import functions as F

from flowlab.operators.clean import assert_varying
from flowlab.plans.flow_tables import prepare_csv_flows, prepare_flows


@pytest.fixture(scope="module")
def flows(spark):
    n = F.col("id")
    return spark.range(1200).select(
        n.alias("row"), F.concat(F.lit("C"), n.cast("string")).alias("uid"), F.lit("h").alias("id.orig_h"),
        F.when(n % 9 == 0, None).otherwise((n % 100).cast("string")).alias("orig_bytes"),
        F.when(n % 4 == 0, None).otherwise(F.concat(F.lit("p"), (n % 3).cast("string"))).alias("proto"),
        F.lit(0.0).alias("local_orig"), F.lit("x").alias("ts_dns"),
        F.when(n % 6 == 0, "(empty)   Malicious   DDoS").when(n % 60 == 1, "-   Malicious   -").otherwise("-").alias("label"),
    )


def test_prepare_flows(spark, flows):
    made = prepare_flows(flows, ["row"], target=100, minimum=5, exclude=["row"], keep=["row"])
    rows = {r["row"]: r for r in made.table.collect()}
    assert made.features == ["orig_bytes", "proto"] and made.constant == ["local_orig"]
    assert {r["label_str"]: r["label"] for r in made.labels.collect()} == {"Benign": 0, "DDoS": 1, "Malicious_Unknown": 2}
    counts = {r["label"]: r["count"] for r in made.table.groupBy("label").count().collect()}
    assert counts == {0: 100, 1: 100, 2: 20}
    for i, r in rows.items():
        assert r["orig_bytes"] == (0.0 if i % 9 == 0 else i % 100)
        assert r["proto"] == (-1.0 if i % 4 == 0 else i % 3)
        assert r["label"] == (1 if i % 6 == 0 else 2 if i % 60 == 1 else 0)
    assert_varying(made.table, made.features)
    assert dict(made.table.dtypes)["proto"] == "float"


def test_numbers_as_text_codes(spark, flows):
    made = prepare_flows(flows, ["row"], target=50, minimum=5, exclude=["row"], keep=["row"], numeric_strings="codes")
    order = sorted({str(i % 100) for i in range(1200) if i % 9})
    for r in made.table.collect():
        i = r["row"]
        assert r["orig_bytes"] == (-1.0 if i % 9 == 0 else order.index(str(i % 100)))


def test_key_may_be_an_identifier(spark, flows):
    made = prepare_flows(flows, ["uid"], target=10, minimum=5, exclude=["row"])
    assert made.table.columns == ["orig_bytes", "proto", "label"] and made.table.count() == 30


def test_prepare_csv_flows(spark):
    n = F.col("id")
    rows = spark.range(900).select(
        n.alias("row"), (n % 50).cast("double").alias("Rate"), F.lit(3.0).alias("flat"),
        F.when(n % 2 == 0, "tcp").otherwise("udp").alias("Protocol Type"),
        F.when(n % 10 == 0, float("inf")).otherwise(n.cast("double")).alias("wild"),
        F.when(n % 3 == 0, " xss").when(n % 3 == 1, "Benign").otherwise("other").alias("Label"),
    )
    made = prepare_csv_flows(rows, ["row"], target=200, minimum=5, exclude=["row"])
    made.verify()
    assert made.features == ["Rate", "Protocol Type", "wild"] and made.constant == ["flat"]
    assert {r["label_str"]: r["label"] for r in made.labels.collect()} == {"Benign": 0, "WebAttack": 1}
    stats = made.table.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{c}{i}") for c in made.features for i, f in enumerate((F.avg, F.stddev_pop))]).first()
    assert list(stats) == pytest.approx([0, 1] * 3, abs=1e-5)
    assert made.table.count() == 400
