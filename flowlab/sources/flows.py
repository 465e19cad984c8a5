"""Flow tables: Parquet, CSV sets, and the sinks they go to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from ..functions.scalars import quoted


def read_flows(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet flow table.  Split sizes bound memory: see ``spark.sql.files.maxPartitionBytes``."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*[quoted(c) for c in columns]) if columns else df


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows; on a Parquet scan no column is read."""
    return df.agg(F.count("*").alias("rows"))


def read_flow_csv(
    spark: SparkSession,
    directory: str,
    pattern: str = "Merged*.csv",
    label: str = "Label",
    text: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """CSV files below a directory as one table; every feature a double, ``text`` as it is.

    Names come from the header (one line is read) unless ``columns`` gives them.
    Values are cast after reading, so ``inf`` in any spelling is a number and
    unreadable text is NULL instead of an error.
    """
    reader = spark.read.option("header", True).option("pathGlobFilter", pattern)
    names = list(columns) if columns else reader.csv(directory).columns
    if label not in names:
        raise ValueError(f"no column {label!r} among {names}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = reader.option("enforceSchema", False).schema(schema).csv(directory)
    as_text = {label, *text}

    def typed(name: str) -> Column:
        return quoted(name) if name in as_text else quoted(name).try_cast("double").alias(name)

    return raw.select(*[typed(n) for n in names])


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """Snappy Parquet sink; ``files`` bounds the number of files of a small result."""
    out = df.coalesce(files) if files else df
    out.write.mode(mode).option("compression", "snappy").parquet(path)


def write_label_map(dim: DataFrame, path: str, coarse: DataFrame | None = None, mode: str = "overwrite") -> None:
    """Label dimension as JSON lines: class to code, code to class, and the coarse map if given."""
    rows = dim.select(
        F.lit("str_to_int").alias("map"), F.col("label_str").alias("key"), F.col("label").cast("string").alias("value")
    ).unionByName(
        dim.select(F.lit("int_to_str").alias("map"), F.col("label").cast("string").alias("key"), F.col("label_str").alias("value"))
    )
    if coarse is not None:
        rows = rows.unionByName(
            coarse.select(F.lit("coarse_label_map").alias("map"), F.col("fine").alias("key"), F.col("coarse").alias("value"))
        )
    rows.coalesce(1).write.mode(mode).json(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """Label dimension back from its JSON form."""
    return (
        spark.read.schema("map string, key string, value string").json(path)
        .filter("map = 'str_to_int'")
        .select(F.col("key").alias("label_str"), F.col("value").cast("bigint").alias("label"))
    )
