import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowlab.operators import windows
from flowlab.plans.window_table import window_table
from flowlab.streaming import flows as streams

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, at(0), "u1", 1.0, "a", "Benign"),
        (2, at(4), "u1", 3.0, None, "DDoS"),
        (3, at(4), "u2", None, "b", "C&C"),
        (4, at(5), "u3", 7.0, "c", "Benign"),
        (5, at(21), "u4", 9.0, "c", "C&C"),
        (6, at(22), "u4", 9.0, "c", "Benign"),
    ]
    return spark.createDataFrame(
        data, "id int, ts timestamp_ntz, uid string, duration double, service string, label string"
    )


def by_start(df):
    return {r["window_start"]: r for r in df.collect()}


def test_features(rows):
    got = by_start(windows.window_features(rows, "5 seconds", ["duration"], ["service"], uid="uid"))
    first = got[at(0)]
    assert (first["duration_min"], first["duration_max"], first["duration_mean"]) == (1.0, 3.0, 2.0)
    assert (first["flow_count"], first["packet_count"]) == (2, 3)
    assert (first["service_count"], first["service_nunique"]) == (2, 2)
    assert set(got) == {at(0), at(5), at(20)}


def test_first_and_last_skip_nulls(rows):
    got = by_start(windows.window_features(rows, "5 seconds", edges=["service"], order=["ts", "id"]))[at(0)]
    assert (got["service_first"], got["service_last"], got["service_nunique"]) == ("a", "b", 2)


def test_labels(rows):
    any_ = by_start(windows.window_label(rows, "5 seconds", "any"))
    assert [any_[k]["label"] for k in sorted(any_)] == [1, 0, 1]
    first = by_start(windows.window_label(rows, "5 seconds", "first_attack", order=["ts", "id"]))
    assert [first[k]["label"] for k in sorted(first)] == ["DDoS", "Benign", "C&C"]
    mode = by_start(windows.window_label(rows, "5 seconds", "mode"))
    # ties go to the smallest name
    assert [mode[k]["label"] for k in sorted(mode)] == ["Benign", "Benign", "Benign"]
    with pytest.raises(ValueError):
        windows.window_label(rows, "5 seconds", "median")


@pytest.mark.parametrize("block", [1, 2, 100_000])
def test_empty_windows(rows, block):
    table = windows.window_features(rows, "5 seconds", ["duration"], uid="uid")
    got = by_start(windows.densify_windows(table, "5 seconds", counts=["packet_count"], block=block))
    assert sorted(got) == [at(s) for s in (0, 5, 10, 15, 20)]
    assert got[at(10)]["packet_count"] == 0 and got[at(10)]["duration_mean"] is None


@pytest.mark.parametrize("size, days", [("7 days", 100), ("7 minutes", 40), ("60 days", 100), ("11 hours", 90)])
def test_no_window_is_lost_for_any_size(spark, size, days):
    rows = spark.range(days * 4).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 6, 5) * id").alias("ts"))
    table = windows.window_features(rows, size, uid="ts")
    dense = windows.densify_windows(table, size, counts=["packet_count"], block=13)
    assert dense.agg(F.sum("packet_count")).first()[0] == days * 4
    assert dense.filter("packet_count > 0").count() == table.count() and dense.count() >= table.count()


def test_plans_do_not_sort_rows(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    tables = [
        windows.window_features(source, "5 seconds", ["duration"], ["service"], ["service"], order=["ts", "id"], uid="uid"),
        windows.window_label(source, "5 seconds", "first_attack", order=["ts", "id"]),
        window_table(source, "5 seconds", text=["service"], rule="mode"),
    ]
    for table in tables:
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan
        # texts at the ends of windows are only sorted after the filter by the ends
        assert "min_by" not in plan and "max_by" not in plan or table is tables[2]
    mode = tables[2]._jdf.queryExecution().executedPlan().toString()
    assert mode.count("coalesce(window_start") == 0


def test_edges_that_tie_give_the_smallest_text(spark):
    tied = spark.createDataFrame([(at(0), "b"), (at(0), "a"), (at(1), None), (at(3), "d"), (at(3), "c")], "ts timestamp_ntz, s string")
    got = windows.window_features(tied, "5 seconds", edges=["s"]).first()
    assert (got["s_first"], got["s_last"], got["s_nunique"]) == ("a", "c", 4)


def test_approximate_counts(rows):
    got = by_start(window_table(rows, "5 seconds", text=["service"], approximate=True))
    assert got[at(0)]["flow_count"] == 2 and got[at(0)]["service_nunique"] == 2


def test_window_table_rules(rows):
    dense = by_start(window_table(rows, "5 seconds", densify=True, fill=0.0))
    assert [dense[k]["label"] for k in sorted(dense)] == [1, 0, 0, 0, 1]
    assert dense[at(10)]["duration_mean"] == 0.0 and dense[at(0)]["duration_min"] == 0.0
    mode = by_start(window_table(rows, "5 seconds", rule="mode", text=["service"], edges=[]))
    assert mode[at(0)]["label"] == "Benign" and mode[at(20)]["service_count"] == 2


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_partitions_do_not_matter(rows, partitions):
    got = window_table(rows.repartition(partitions), "5 seconds", rule="first_attack", order=["ts", "id"])
    assert [r["label"] for r in got.orderBy("window_start").collect()] == ["DDoS", "Benign", "C&C"]


def test_stream_equals_batch(spark, rows, tmp_path):
    source = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(source)
    feed = streams.stream_files(spark, source, rows.schema)
    got = streams.run_to_table(
        streams.stream_window_features(feed, "5 seconds", "0 seconds", ["duration"], uid="uid"),
        str(tmp_path / "out"), str(tmp_path / "progress"),
    )
    batch = windows.window_features(rows, "5 seconds", ["duration"], uid="uid").filter(
        F.col("window_start") + F.expr("interval 5 seconds") <= F.lit(at(22)).cast("timestamp_ntz")
    )
    cols = ["duration_min", "duration_max", "duration_mean", "packet_count", "flow_count"]
    stamped = got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    pick = lambda df: sorted(map(tuple, df.select("window_start", *cols).collect()))
    assert pick(stamped) == pick(batch)


def test_stream_with_an_end_gives_all_windows(spark, rows, tmp_path):
    source = str(tmp_path / "in")
    rows.repartition(3).write.parquet(source)
    feed = streams.stream_files(spark, source, rows.schema)
    stream = streams.stream_window_features(feed, "5 seconds", "0 seconds", ["duration"], uid="uid")
    got = streams.run_to_end(stream).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    batch = windows.window_features(rows, "5 seconds", ["duration"], uid="uid")
    pick = lambda df: sorted(map(tuple, df.select(*batch.columns).collect()))
    assert pick(got) == pick(batch)
