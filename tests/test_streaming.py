from pyspark.sql import functions as F

from flowlab.sources.telemetry import TELEMETRY, to_telemetry
from flowlab.streaming import flows as streams


def test_telemetry_stream_goes_on_where_it_stopped(spark, tmp_path):
    feed, table, progress = (str(tmp_path / n) for n in ("feed", "table", "progress"))
    schema = to_telemetry(spark.range(0)).schema

    def log(rnd, acc):
        rows = spark.range(1).select(
            F.lit("A").alias("condition"), F.lit(1).alias("run"), F.lit(rnd).alias("server_round"),
            F.lit("aggregate").alias("client_id"), F.lit(acc).alias("global_accuracy"), F.lit(1.0).alias("global_loss"),
        )
        to_telemetry(rows).write.mode("append").parquet(feed)

    def run():
        streams.append_telemetry_stream(streams.stream_files(spark, feed, schema), table, progress)
        return streams.read_telemetry_table(spark, table)

    log(1, 0.5)
    assert run().count() == 1
    log(2, 0.7)
    run()
    log(2, 0.6)
    log(2, 0.5)
    both = run()
    assert both.columns == list(TELEMETRY) and both.count() == 2
    assert run().count() == 2
    newest = streams.latest_round(both).first()
    assert (newest["server_round"], newest["global_accuracy"]) == (2, 0.6)


def test_run_to_end_twice_gives_the_same_groups(spark, tmp_path):
    feed, out, progress = (str(tmp_path / n) for n in ("feed", "out", "progress"))
    schema = "ts timestamp, v double"

    def add(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(feed)

    def run():
        flows = streams.stream_files(spark, feed, spark.createDataFrame([], schema).schema)
        counts = flows.groupBy(F.window("ts", "10 seconds").start.alias("start")).agg(F.count("*").alias("n"))
        return sorted(tuple(r) for r in streams.run_to_end(counts, out, progress).collect())

    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    add([(t, 1.0), (t + dt.timedelta(seconds=12), 2.0)])
    first = run()
    assert [n for _, n in first] == [1, 1]
    assert run() == first  # nothing new: the same groups, not none
    add([(t + dt.timedelta(seconds=3), 3.0)])
    third = run()
    assert [n for _, n in third] == [2, 1]
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) == 1
