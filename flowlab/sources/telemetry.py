"""Round telemetry: schema, CSV scan, append sink, combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns and their order in a telemetry file.
TELEMETRY = {
    "condition": "string",
    "run": "int",
    "server_round": "int",
    "client_id": "string",
    "train_time_ms": "double",
    "pqc_total_overhead_ms": "double",
    "pqc_encap_ms": "double",
    "sym_enc_ms": "double",
    "encrypted_payload_bytes": "bigint",
    "plaintext_payload_bytes": "bigint",
    "is_encrypted": "boolean",
    "dp_enabled": "boolean",
    "epsilon_consumed": "double",
    "global_loss": "double",
    "global_accuracy": "double",
    "eval_client_id": "string",
    "eval_loss": "double",
    "eval_accuracy": "double",
}

TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TELEMETRY])


def to_telemetry(df: DataFrame) -> DataFrame:
    """Align any table to the telemetry columns: missing ones NULL, unreadable values NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(c).try_cast(t) if c in have else F.lit(None).cast(t)).alias(c)
            for c, t in TELEMETRY.items()
        ]
    )


def read_telemetry(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Telemetry CSV files with a header; empty or unreadable numbers become NULL."""
    return to_telemetry(spark.read.option("header", True).schema(TEXT_SCHEMA).csv(path))


def append_telemetry(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows in the fixed column order, as Parquet or as CSV with headers."""
    writer = to_telemetry(df).write.mode("append").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def combine_telemetry(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """Read several telemetry files as one, write them together as CSV, return the rows."""
    rows = read_telemetry(spark, paths)
    rows.write.option("header", True).csv(out)
    return rows


def round_metrics(updates: DataFrame) -> DataFrame:
    """Telemetry rows of client updates: sizes, clocks and flags of one round.

    ``updates`` has the identifying columns, ``plain_bytes``, ``sealed_bytes`` (NULL
    when sent plain), ``encap_ns``, ``sym_enc_ns``, ``train_ns`` and ``epsilon`` (NULL
    when noise is off).  Plain payloads count as 0 ms of sealing; a sealed payload
    whose clocks were not read has NULL.
    """
    sealed = F.col("sealed_bytes").isNotNull()
    encap = F.when(sealed, F.col("encap_ns") / 1e6).otherwise(F.lit(0.0))
    enc = F.when(sealed, F.col("sym_enc_ns") / 1e6).otherwise(F.lit(0.0))
    return to_telemetry(
        updates.select(
            "condition", "run", "server_round", F.col("client_id").cast("string").alias("client_id"),
            (F.col("train_ns") / 1e6).alias("train_time_ms"),
            (encap + enc).alias("pqc_total_overhead_ms"),
            encap.alias("pqc_encap_ms"), enc.alias("sym_enc_ms"),
            F.coalesce("sealed_bytes", "plain_bytes").alias("encrypted_payload_bytes"),
            F.col("plain_bytes").alias("plaintext_payload_bytes"),
            sealed.alias("is_encrypted"),
            F.col("epsilon").isNotNull().alias("dp_enabled"),
            F.coalesce("epsilon", F.lit(-1.0)).alias("epsilon_consumed"),
        )
    )
