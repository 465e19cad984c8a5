"""Codes for classes and text columns, and feature scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import BENIGN
from ..functions.scalars import quoted
from ..scratch import materialize
from .ordering import lookup, running_total


def fit_label_encoder(df: DataFrame, col: str) -> DataFrame:
    """Class dimension ``(label_str, label)``: Benign is 0, the others alphabetical."""
    return number_labels(df.select(quoted(col).alias("label_str")).distinct())


def number_labels(names: DataFrame) -> DataFrame:
    """Codes for a table of distinct class names ``label_str``."""
    known = names.filter("label_str is not null").withColumn("_other", F.col("label_str") != BENIGN)
    ranked = running_total(known, ["_other", "label_str"], {"label": F.lit(1).cast("bigint")})
    return ranked.select("label_str", (F.col("label") - 1).alias("label"))


def encode_labels(df: DataFrame, dim: DataFrame, col: str, out: str = "label") -> DataFrame:
    """Replace class names by the codes of a fitted dimension."""
    codes = dim.select(F.col("label_str").alias(col), F.col("label").alias("_code"))
    return lookup(df, codes, [col], ["_code"]).drop(col).withColumnRenamed("_code", out)


def fit_ordinal_encoder(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Dictionary ``(col, value, code)`` of several text columns; codes from 0 by value.

    Distinct values are ranked by running totals over range blocks, so a column of
    billions of values is numbered by many tasks.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), quoted(c).cast("string").alias("value")) for c in cols]))
    distinct = df.select(pairs.alias("p")).select("p.col", "p.value").filter("value is not null").distinct()
    ranked = running_total(distinct, ["value"], {"code": F.lit(1).cast("bigint")}, ["col"])
    return materialize(ranked.withColumn("code", F.col("code") - 1), "dictionary")


def apply_ordinal_encoder(df: DataFrame, dictionary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace text columns by their codes; NULL becomes -1.

    The planner picks each join by the dictionary's size on disk: small ones are
    broadcast, for large ones the adaptive skew join splits frequent values.
    """
    out = df
    for i, c in enumerate(cols):
        side = dictionary.filter(F.col("col") == c).select(
            F.col("value").alias(f"_value_{i}"), F.col("code").alias(f"_code_{i}")
        )
        out = out.join(side, quoted(c).cast("string") == F.col(f"_value_{i}"), "left").drop(f"_value_{i}")
    codes = {c: F.coalesce(F.col(f"_code_{i}"), F.lit(-1).cast("bigint")) for i, c in enumerate(cols)}
    return out.select(*[codes[c].alias(c) if c in codes else quoted(c) for c in df.columns])


def restrict_dictionary(dictionary: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Only the entries a small table needs, so a dictionary of billions is never shuffled."""
    needed = F.array(*[F.struct(F.lit(c).alias("col"), quoted(c).cast("string").alias("value")) for c in cols])
    return dictionary.join(df.select(F.inline(needed)), ["col", "value"], "left_semi")


def ordinal_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns to ordinal codes in one call."""
    return apply_ordinal_encoder(df, fit_ordinal_encoder(df, cols), cols)


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of means and population standard deviations (0 counts as 1)."""
    stats = []
    for c in cols:
        x = quoted(c).cast("double")
        spread = F.stddev_pop(x)
        stats += [F.avg(x).alias(f"{c}_mean"), F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias(f"{c}_std")]
    return df.agg(*stats)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardise columns with fitted statistics, held in a one-row scalar subquery."""
    row = stats.select(F.struct("*").alias("s")).scalar()
    scaled = {
        c: ((quoted(c).cast("double") - row[f"{c}_mean"]) / row[f"{c}_std"]).alias(c) for c in cols
    }
    return df.select(*[scaled.get(c, quoted(c)) for c in df.columns])
