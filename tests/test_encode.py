import pytest
from pyspark.sql import functions as F

from flowlab.operators import encode


def test_label_encoder(spark):
    names = spark.createDataFrame([("Zeta",), ("Benign",), ("Alpha",), ("Alpha",)], "l string")
    dim = encode.fit_label_encoder(names, "l")
    assert {r["label_str"]: r["label"] for r in dim.collect()} == {"Benign": 0, "Alpha": 1, "Zeta": 2}
    assert sorted(r["label"] for r in encode.encode_labels(names, dim, "l").collect()) == [0, 1, 1, 2]
    without = encode.fit_label_encoder(names.filter("l <> 'Benign'"), "l")
    assert {r["label_str"]: r["label"] for r in without.collect()} == {"Alpha": 0, "Zeta": 1}


def test_ordinal_codes(spark):
    rows = spark.range(200).select(
        "id",
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("u"), F.col("id").cast("string"))).alias("uri"),
        F.when(F.col("id") % 2 == 0, "tcp").otherwise("Udp").alias("proto"),
    )
    book = encode.fit_ordinal_encoder(rows, ["uri", "proto"])
    assert dict(book.dtypes)["code"] == "bigint"
    got = {r["id"]: r for r in encode.apply_ordinal_encoder(rows, book, ["uri", "proto"]).collect()}
    order = sorted(f"u{i}" for i in range(200) if i % 7)
    for i in range(200):
        assert got[i]["uri"] == (order.index(f"u{i}") if i % 7 else -1)
        assert got[i]["proto"] == (1 if i % 2 == 0 else 0)


def test_scaler_uses_population_deviation(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, flat double")
    got = encode.apply_scaler(rows, encode.fit_scaler(rows, ["a", "flat"]), ["a", "flat"]).collect()
    assert [r["a"] for r in got] == pytest.approx([-1.2247448, 0, 1.2247448])
    assert [r["flat"] for r in got] == [0.0, 0.0, 0.0]
