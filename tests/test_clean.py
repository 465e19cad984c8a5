import pytest
from pyspark.sql import functions as F

from flowlab.operators import clean


def test_find_label_column(spark):
    rows = spark.createDataFrame([(1, "a", "b")], "x int, type string, Label string")
    assert clean.find_label_column(rows) == "Label"
    with pytest.raises(ValueError, match="x"):
        clean.find_label_column(rows.select("x"))


def test_drop_identifiers_with_dots_and_suffixes(spark):
    names = ["uid", "id.orig_h", "id.resp_p_dns", "ts_ssl", "ts_http", "proto"]
    rows = spark.createDataFrame([tuple("abcdef")], names)
    assert clean.drop_identifiers(rows).columns == ["proto"]
    assert clean.drop_identifiers(rows, suffixes=()).columns == ["id.resp_p_dns", "ts_ssl", "proto"]


def test_constant_columns_count_null_as_a_value(spark):
    rows = spark.createDataFrame(
        [(1, None, 5, "a", float("nan")), (1, None, None, "b", float("nan"))],
        "same int, gone int, half int, text string, nan double",
    )
    assert clean.constant_columns(rows, rows.columns) == ["same", "gone", "nan"]
    kept, dropped = clean.drop_constant_columns(rows, exclude=["same"])
    assert kept.columns == ["same", "half", "text"] and dropped == ["gone", "nan"]
    clean.assert_varying(rows, ["half", "text"])
    with pytest.raises(ValueError, match="same"):
        clean.assert_varying(rows, ["same"])


def test_drop_incomplete(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, None), (None, float("nan")), (3, float("nan"))], "a int, b double")
    assert clean.drop_incomplete(rows, ["a", "b"]).count() == 1
    assert clean.drop_incomplete(rows, ["a", "b"], how="all").count() == 3


def test_fill_defaults(spark):
    rows = spark.createDataFrame(
        [(None, None, None, None), (float("nan"), 1, "x", "DDoS")], "d double, n bigint, t string, label string"
    )
    assert [tuple(r) for r in clean.fill_defaults(rows).collect()] == [
        (0.0, 0, "None", "Benign"), (0.0, 1, "x", "DDoS"),
    ]


def test_profiles(spark):
    rows = spark.createDataFrame([(1.0, "a"), (float("inf"), None), (float("nan"), "a"), (None, "b")], "x double, t string")
    got = clean.quality_profile(rows, ["x"]).first()
    assert (got["missing"], got["infinite"]) == (2, 1)
    counts = {r["col"]: r["distinct_values"] for r in clean.distinct_profile(rows, ["x", "t"]).collect()}
    assert counts == {"x": 4, "t": 3}


def test_selection_and_text(spark):
    rows = spark.createDataFrame([(1.0, "-", "(empty)")], "duration double, a string, b string")
    assert clean.select_features(rows, ["orig_bytes", "duration"], keep=["a"]).columns == ["a", "duration"]
    assert tuple(clean.null_text_sentinels(rows).first()) == (1.0, None, None)
    assert clean.numeric_cols(rows) == ["duration"] and clean.text_cols(rows, ["a"]) == ["b"]
    assert clean.stringify(rows, ["duration"]).dtypes[0][1] == "string"
    assert clean.clean_numeric(rows, ["duration"]).select(F.col("duration")).dtypes[0][1] == "float"
