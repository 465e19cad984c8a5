"""Window features and telemetry on streams of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import quoted
from ..operators.windows import START, numeric_features, traffic_counts
from ..scratch import scratch_path
from ..sources.telemetry import to_telemetry

TELEMETRY_KEY = ("condition", "run", "server_round", "client_id", "eval_client_id")


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None
) -> DataFrame:
    """A stream of the files that appear below a path."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def stream_window_features(
    flows: DataFrame,
    size: str,
    delay: str,
    numeric: Sequence[str] = (),
    uid: str | None = None,
    ts: str = "ts",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Window features of a stream of flows, with the same names as in batch.

    Rows later than ``delay`` behind the newest are dropped, and a window is final
    once the newest row is ``delay`` past its end.  ``flow_count`` is approximate,
    as streams have no exact distinct count.
    """
    timed = flows.withColumn(ts, quoted(ts).cast("timestamp")).withWatermark(ts, delay)
    return (
        timed.groupBy(F.window(quoted(ts), size).alias("_w"))
        .agg(*numeric_features(numeric), *traffic_counts(uid, approximate=True), *extra)
        .withColumn(START, F.col("_w.start"))
        .drop("_w")
    )


def run_to_table(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all input there is, append final rows to a table, return the table.

    With the same ``path`` and ``checkpoint`` a later call goes on where this ended;
    windows that may still get rows wait until then.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "progress"))
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_to_end(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an aggregating stream over input that has an end, and return all its groups.

    No group waits for rows that will not come.  Every micro-batch writes the whole
    result beside the last one, so a batch that is run again replaces itself.  The
    result is the newest complete batch found in ``path``, so a later call with the
    same ``path`` and ``checkpoint`` and no new input returns the same groups; older
    batches are removed once a newer one is complete.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(sink).outputMode("complete")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    newest = _newest_batch(spark, path)
    if newest is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(newest)


def _newest_batch(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest batch whose write completed; older ones are deleted."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    done = {}
    for status in fs.listStatus(root):
        place = status.getPath()
        name = place.getName()
        if name.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
            done[int(name[len("batch="):])] = place
    if not done:
        return None
    newest = max(done)
    for number, place in done.items():
        if number < newest:
            fs.delete(place, True)
    return done[newest].toString()


def append_telemetry_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append telemetry from a stream, each micro-batch to its own partition.

    A batch that is run again after a failure replaces its own partition, so every
    row arrives once.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        to_telemetry(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def read_telemetry_table(spark: SparkSession, path: str) -> DataFrame:
    """The streamed telemetry, one row per key: of copies the one from the newest batch.

    Copies that differ within a batch give the one whose values are largest, column
    by column, so the choice does not depend on how rows arrive.
    """
    rows = spark.read.parquet(path)
    cells = to_telemetry(rows).columns
    newest = F.max(F.struct(F.col("batch"), *[c for c in cells if c not in TELEMETRY_KEY])).alias("row")
    kept = rows.groupBy(*TELEMETRY_KEY).agg(newest)
    return to_telemetry(kept.select(*TELEMETRY_KEY, "row.*"))


def latest_round(telemetry: DataFrame) -> DataFrame:
    """The newest global loss and accuracy of every condition and run."""
    state = F.struct("server_round", "global_accuracy", "global_loss")
    return (
        telemetry.filter("client_id = 'aggregate'")
        .groupBy("condition", "run")
        .agg(F.max(state).alias("s"))
        .select("condition", "run", "s.server_round", "s.global_accuracy", "s.global_loss")
    )
