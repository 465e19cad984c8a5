import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowlab.functions import labels, scalars, vectors


@pytest.mark.parametrize("raw,want", [
    ("(empty)   Malicious   PartOfAHorizontalPortScan", "PartOfAHorizontalPortScan"),
    ("(empty)\tMalicious\tC&C", "C&C"),
    ("(empty)\tBenign\t-", "Benign"),
    ("-   benign   -", "Benign"),
    ("Benign", "Benign"),
    ("benign", "benign"),
    ("(empty)   Malicious   -", "Malicious_Unknown"),
    ("-", "Benign"), ("", "Benign"), ("(empty)", "Benign"), ("nan", "Benign"), (None, "Benign"),
    ("  \tx ", "x"),
    ("-   (empty)   -", "Benign"),
    ("a\tb   c", "b   c"),
    ("Malicious   DDoS   Malicious", "DDoS"),
    ("  two words  ", "two words"),
    (" DDoS ", "DDoS"),
])
def test_parse_zeek_label(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "raw string").select(labels.parse_zeek_label(F.col("raw"))).first()
    assert row[0] == want


def test_coarse_label_ignores_case_and_spaces(spark):
    rows = spark.createDataFrame([(" ddos-syn_flood ",), ("BENIGN",), ("BenignTraffic",), (None,)], "raw string")
    got = [r[0] for r in rows.select(labels.coarse_label(F.col("raw"))).collect()]
    assert got == ["DDoS", "Benign", "", ""]
    assert len(labels.COARSE_CLASSES) == 34
    assert set(labels.COARSE_CLASSES.values()) == {"DDoS", "DoS", "Mirai", "Recon", "Spoofing", "WebAttack", "Benign"}


def test_numbers_and_times(spark):
    rows = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("inf",)], "v string")
    got = [tuple(r) for r in rows.select(scalars.to_num(F.col("v")), scalars.to_num(F.col("v"), 0.0)).collect()]
    assert got[:4] == [(1.5, 1.5), (None, 0.0), (None, 0.0), (None, 0.0)]
    assert got[4][0] == float("inf")
    times = spark.createDataFrame([("1525879831.25",), ("bad",), (None,)], "v string")
    got = [r[0] for r in times.select(scalars.to_ts(F.col("v")).cast("timestamp_ntz")).collect()]
    assert got == [dt.datetime(2018, 5, 9, 15, 30, 31, 250000), None, None]


def test_clean_number_overflow_and_gaps(spark):
    rows = spark.createDataFrame([(1e300,), (float("-inf"),), (float("nan"),), (None,), (0.1,)], "v double")
    got = [r[0] for r in rows.select(scalars.clean_number(F.col("v"))).collect()]
    assert got[:4] == [0.0] * 4 and got[4] == pytest.approx(0.1, rel=1e-6)


def test_hash_order_needs_only_the_key(spark):
    rows = spark.range(100)
    one = rows.repartition(1).select("id", scalars.hash_order(1, F.col("id")).alias("h"))
    many = rows.repartition(16).select("id", scalars.hash_order(1, F.col("id")).alias("h"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], 0.0, 1.0)], "v array<double>, a double, b double")
    got = row.select(
        vectors.l2_norm(F.col("v")), vectors.clip_l2(F.col("v"), 1.0), vectors.clip_l2(F.col("v"), 9.0),
        vectors.assemble(["a", "b"]), vectors.clip_l2(F.array(F.lit(0.0)), 1.0),
    ).first()
    assert got[0] == 5.0 and got[1] == pytest.approx([0.6, 0.8]) and got[2] == [3.0, 4.0]
    assert got[3] == [0.0, 1.0] and got[4] == [0.0]
