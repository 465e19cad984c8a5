"""Ranks, running totals and per-group cuts without one-task sorts.

A window over a whole table, or over a class that holds a third of it, lands in
one task.  The helpers here replace such windows: running totals work on range
blocks with offsets, and per-group samples use a cut point found from counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quoted
from ..scratch import materialize


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str], values: Sequence[str], how: str = "left") -> DataFrame:
    """Add ``values`` from a table with unique keys; NULL keys match NULL keys."""
    side = dim.select(*[quoted(k).alias(f"_lookup_{i}") for i, k in enumerate(keys)], *values)
    on = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(quoted(f"_lookup_{i}")) for i, k in enumerate(keys)])
    return df.join(side, on, how).drop(*[f"_lookup_{i}" for i in range(len(keys))])


def running_total(
    df: DataFrame,
    order: Sequence[str],
    totals: dict[str, Column],
    group: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Add inclusive running sums per group, in the given order, over many tasks.

    ``totals`` maps a new column to the value summed.  ``group + order`` should be
    unique.  Rows are range-partitioned into blocks (their number follows the size of
    the data unless given), written once so that block numbers stay fixed, summed
    inside each block and shifted by the total of the blocks before.  A group that
    holds most rows is spread over many blocks.
    """
    keys = [quoted(k) for k in [*group, *order]]
    values = {name: f"_value_{i}" for i, name in enumerate(totals)}
    staged = df.select("*", *[expr.alias(values[name]) for name, expr in totals.items()])
    ranged = staged.repartitionByRange(blocks, *keys) if blocks else staged.repartitionByRange(*keys)
    ranged = materialize(ranged.withColumn("_block", F.spark_partition_id()), "blocks")
    per_block = ranged.groupBy(*[quoted(g) for g in group], "_block").agg(
        *[F.sum(v).alias(f"{v}_sum") for v in values.values()]
    )
    # one row per (group, block): bounded by groups times blocks
    before = (
        Window.partitionBy(*[quoted(g) for g in group])
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_block.select(
        *[quoted(g) for g in group],
        "_block",
        *[F.coalesce(F.sum(f"{v}_sum").over(before), F.lit(0)).alias(f"{v}_before") for v in values.values()],
    )
    inside = (
        Window.partitionBy(*[quoted(g) for g in group], "_block")
        .orderBy(*[quoted(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = ranged.select("*", *[F.sum(v).over(inside).alias(f"{v}_local") for v in values.values()])
    shifted = lookup(local, offsets, [*group, "_block"], [f"{v}_before" for v in values.values()], "inner")
    return shifted.select(
        *[quoted(c) for c in df.columns],
        *[(F.col(f"{v}_local") + F.col(f"{v}_before")).alias(name) for name, v in values.items()],
    )


def hash_rank(df: DataFrame, group: Sequence[str], hashed: Column, key: Sequence[str], out: str) -> DataFrame:
    """Add the rank from 1 of every row in its group's hash order; ``key`` is unique.

    A running total of ones: rows go to range blocks, whatever the size of a group.
    """
    keyed = df.withColumn("_hash", hashed)
    return running_total(keyed, ["_hash", *key], {out: F.lit(1).cast("bigint")}, group).drop("_hash")


def class_sizes(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """``(group, _rows)``: group sizes, written once."""
    return materialize(df.groupBy(*[quoted(g) for g in group]).agg(F.count("*").alias("_rows")), "sizes")


# leading hex digits of a hash that place a row in one of 4,096 buckets
PREFIX = 3


def _edge(counts: DataFrame, keys: Sequence[Column], want: Column) -> DataFrame:
    """The ``_cut`` at which a group's running ``_ties`` reach what it wants, and what it still wants there."""
    running = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("_upto", F.sum("_ties").over(running)).withColumn("_left", want)
    found = upto.filter("_upto >= _left and _upto - _ties < _left")
    need = F.col("_left") - F.col("_upto") + F.col("_ties")
    return materialize(found.select(*keys, "_cut", need.alias("_need"), "_ties"), "cuts")


def hash_buckets(
    rows: DataFrame, group: Sequence[str], hashed: str, quota: Callable[[Column], Column], sizes: DataFrame | None = None
) -> DataFrame:
    """The bucket of each group's ``quota``-th lowest hash: group, ``_prefix``, ``_need`` (rows to keep inside it).

    One pass: a histogram over hash prefixes, a partial aggregate of at most 4,096
    rows per group, which also gives the group's size unless ``sizes`` holds it.
    """
    keys = [quoted(g) for g in group]
    counts = rows.groupBy(*keys, F.substring(quoted(hashed), 1, PREFIX).alias("_cut")).agg(F.count("*").alias("_ties"))
    if sizes is None:
        counts = counts.withColumn("_rows", F.sum("_ties").over(Window.partitionBy(*keys)))
    else:
        counts = lookup(counts, sizes, group, ["_rows"], "inner")
    return _edge(counts, keys, quota(F.col("_rows"))).select(*keys, F.col("_cut").alias("_prefix"), "_need")


def cuts_inside(rows: DataFrame, group: Sequence[str], hashed: str, buckets: DataFrame) -> DataFrame:
    """Exact cut point per group inside its bucket, from counts of whole hashes.

    Returns one row per group that keeps anything: the group columns, ``_cut``,
    ``_need`` (rows to keep with exactly that hash) and ``_ties`` (rows having it).
    """
    keys = [quoted(g) for g in group]
    near = lookup(rows, buckets, group, ["_prefix", "_need"], "inner").filter(
        F.substring(quoted(hashed), 1, PREFIX) == F.col("_prefix"))
    whole = near.groupBy(*keys, "_need", quoted(hashed).alias("_cut")).agg(F.count("*").alias("_ties"))
    return _edge(whole, keys, F.col("_need"))


def _grouped(df: DataFrame, group: Sequence[str], hashed: Column) -> tuple[DataFrame, list[str]]:
    """Rows with their hash, and the group columns; without any, all rows are one group."""
    keyed = df.withColumn("_hash", hashed)
    return (keyed, list(group)) if group else (keyed.withColumn("_all", F.lit(0)), ["_all"])


def mark_lowest(
    df: DataFrame, group: Sequence[str], hashed: Column, quota: Callable[[Column], Column], flag: str
) -> DataFrame:
    """Add a boolean: is the row among the ``quota`` lowest hashes of its group?

    Rows that share a hash share a key and get one answer together: the one that
    comes closer to the quota.  With unique keys the count is exact.
    """
    keyed, by = _grouped(df, group, hashed)
    narrow = keyed.select(*[quoted(g) for g in by], "_hash")
    cuts = cuts_inside(narrow, by, "_hash", hash_buckets(narrow, by, "_hash", quota))
    with_ties = (F.col("_need") * 2 >= F.col("_ties")).alias("_with")
    marked = lookup(keyed, cuts.select(*[quoted(g) for g in by], "_cut", with_ties), by, ["_cut", "_with"])
    inside = (F.col("_hash") < F.col("_cut")) | ((F.col("_hash") == F.col("_cut")) & F.col("_with"))
    return marked.select(*[quoted(c) for c in df.columns], F.coalesce(inside, F.lit(False)).alias(flag))


def take_lowest(
    df: DataFrame,
    group: Sequence[str],
    hashed: Column,
    quota: Callable[[Column], Column],
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Exactly the ``quota`` rows with the lowest hashes of every group.

    Two passes over the rows: one counts hash prefixes, one writes the wide rows up to
    the bucket of their group's cut, a few thousandths of the group more than wanted;
    the cut is found among those.  Copies of one key may sit on a cut; just those are
    ranked, by all their columns.
    """
    keyed, by = _grouped(df, group, hashed)
    narrow = [*[quoted(g) for g in by], "_hash"]
    buckets = hash_buckets(keyed.select(*narrow), by, "_hash", quota, sizes)
    upto = materialize(
        lookup(keyed, buckets.drop("_need"), by, ["_prefix"], "inner").filter(
            F.substring("_hash", 1, PREFIX) <= F.col("_prefix")).drop("_prefix"), "near")
    cuts = cuts_inside(upto.select(*narrow), by, "_hash", buckets)
    near = lookup(upto, cuts, by, ["_cut", "_need"], "inner").filter(F.col("_hash") <= F.col("_cut"))
    order = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant") and f.name not in by]
    copies = running_total(near.filter(F.col("_hash") == F.col("_cut")), ["_hash", *order], {"_rank": F.lit(1)}, by)
    kept = near.filter(F.col("_hash") < F.col("_cut")).unionByName(
        copies.filter(F.col("_rank") <= F.col("_need")).drop("_rank"))
    return kept.select(*[quoted(c) for c in df.columns])
