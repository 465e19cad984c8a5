"""Seeded samples, splits, client shards and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import below_fraction, hash_order, quoted
from .ordering import class_sizes, hash_rank, lookup, mark_lowest, take_lowest


def _hash(key: Sequence[str | Column], seed: int) -> Column:
    return hash_order(seed, *[quoted(k) if isinstance(k, str) else k for k in key])


def stratified_sample(
    df: DataFrame,
    label: str,
    target: int,
    minimum: int,
    key: Sequence[str | Column],
    seed: int = 42,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``min(class size, max(target, minimum))`` rows of every class.

    Covers the two-step sampling of very large classes as well: rows are filtered by
    the exact cut of their class in one narrow pass.  ``sizes`` are known class sizes
    ``(label, _rows)``.
    """
    wanted = F.lit(max(target, minimum)).cast("bigint")
    return take_lowest(df, [label], _hash(key, seed), lambda n: F.least(n, wanted), sizes)


def take_all_or_sample(
    df: DataFrame,
    label: str,
    target: int,
    minimum: int,
    key: Sequence[str | Column],
    whole: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Stratified sample that keeps every row of the classes named in ``whole``."""
    if not whole:
        return stratified_sample(df, label, target, minimum, key, seed)
    entire = quoted(label).isin(*whole)
    sampled = stratified_sample(df.filter(~entire), label, target, minimum, key, seed)
    return df.filter(entire).unionByName(sampled)


def fraction_sample(
    df: DataFrame, fraction: float, key: Sequence[str | Column], seed: int = 42
) -> DataFrame:
    """About ``fraction`` of the rows, chosen by key hash in one narrow pass."""
    return df.filter(below_fraction(_hash(key, seed), fraction))


def shuffle_rows(
    df: DataFrame, key: Sequence[str | Column], seed: int = 42, index: str | None = None
) -> DataFrame:
    """All rows in hash order (a range-partitioned sort).

    ``index`` adds the new row number from 0; ``key`` is then made of column names
    and unique, and rows are numbered by many tasks instead of sorted as a whole.
    """
    hashed = _hash(key, seed)
    if index is None:
        return df.orderBy(hashed)
    return hash_rank(df, [], hashed, key, index).withColumn(index, F.col(index) - 1)


def shuffle_for_training(
    df: DataFrame, key: Sequence[str | Column], seed: int = 42, partitions: int | None = None
) -> DataFrame:
    """Rows spread at random over partitions and ordered at random inside each."""
    hashed = _hash(key, seed)
    spread = df.repartition(partitions, hashed) if partitions else df.repartition(hashed)
    return spread.sortWithinPartitions(hashed)


def stratified_split(
    df: DataFrame,
    label: str,
    test: float,
    key: Sequence[str | Column],
    seed: int = 42,
    column: str = "is_test",
) -> DataFrame:
    """Mark ``ceil(test * n)`` rows of every class as test rows."""
    return mark_lowest(
        df, [label], _hash(key, seed), lambda n: F.ceil(F.round(n * F.lit(test), 6)), column
    )


def validation_tail(
    df: DataFrame,
    fraction: float,
    key: Sequence[str | Column],
    seed: int = 42,
    column: str = "is_validation",
) -> DataFrame:
    """Mark ``ceil(fraction * n)`` rows of the whole table as validation rows."""
    return mark_lowest(df, [], _hash(key, seed), lambda n: F.ceil(F.round(n * F.lit(fraction), 6)), column)


def peek(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*[quoted(o) for o in order]).limit(n)


def peek_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The first ``n`` distinct values of a column."""
    return df.select(quoted(col)).distinct().orderBy(quoted(col)).limit(n)


def assign_clients(df: DataFrame, clients: int, key: str, seed: int | None = None) -> DataFrame:
    """Add ``client_id``: row key modulo ``clients``, or its hash when a seed is given."""
    number = quoted(key) if seed is None else F.xxhash64(F.lit(seed), quoted(key))
    return df.withColumn("client_id", F.pmod(number, F.lit(clients)).cast("int"))


def assign_batches(
    df: DataFrame, size: int, key: Sequence[str], by: Sequence[str] = ("client_id",), seed: int = 42
) -> DataFrame:
    """Add ``batch_id``: full batches of ``size`` rows per client, the remainder dropped.

    Rows are numbered in hash order; a client that owns half the table is numbered
    by many tasks.  ``key`` is unique.
    """
    numbered = hash_rank(df, by, _hash(key, seed), key, "_row")
    sizes = class_sizes(df, by)
    return (
        lookup(numbered, sizes, by, ["_rows"])
        .withColumn("batch_id", F.floor((F.col("_row") - 1) / size))
        .filter(F.col("batch_id") < F.floor(F.col("_rows") / size))
        .drop("_row", "_rows")
    )


def column_factor(name: str, seed: int, low: float = 3.0, high: float = 10.0) -> Column:
    """One draw per column from [low, high), fixed by seed and column name."""
    share = F.conv(F.substring(F.md5(F.lit(f"{seed}:{name}")), 1, 8), 16, 10).cast("double") / float(16**8)
    return F.lit(low) + share * F.lit(high - low)


def inject_attacks(
    df: DataFrame,
    label: str,
    rows: int,
    key: Sequence[str],
    seed: int = 42,
    skip: Sequence[str] = ("packet_count", "flow_count"),
) -> DataFrame:
    """Balanced table of normal rows and inflated copies of them marked as attacks.

    Up to ``rows`` rows with label 0 are sampled.  Every numeric column of a copy,
    but for ``skip`` and the key, is multiplied by one factor drawn per column.
    """
    normal = stratified_sample(df.filter(quoted(label) == 0), label, rows, 0, key, seed)
    numbers = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)} - {label, *skip, *key}
    both = normal.withColumn("_attack", F.explode(F.array(F.lit(0), F.lit(1))))
    out = []
    for c in df.columns:
        if c == label:
            out.append(F.col("_attack").cast(df.schema[c].dataType).alias(c))
        elif c in numbers:
            inflated = F.when(F.col("_attack") == 1, column_factor(c, seed)).otherwise(F.lit(1.0))
            out.append((quoted(c).cast("double") * inflated).alias(c))
        else:
            out.append(quoted(c))
    return both.select(*out)
