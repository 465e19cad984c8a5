import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowlab.functions.scalars import hash_order
from flowlab.operators import ordering, sample


def skewed(spark, n=3000):
    # one group holds most rows
    return spark.range(n).select("id", F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"))


def lowest(rows, want, seed=42):
    groups = defaultdict(list)
    for key, g in rows:
        groups[g].append((hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), key))
    return {(k, g) for g, items in groups.items() for _, k in sorted(items)[: want(len(items))]}


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_running_total(spark, partitions):
    rows = skewed(spark).repartition(partitions)
    got = ordering.running_total(rows, ["id"], {"total": F.col("id")}, ["g"], blocks=7).collect()
    sums = defaultdict(int)
    for row in sorted(got, key=lambda r: r["id"]):
        sums[row["g"]] += row["id"]
        assert row["total"] == sums[row["g"]]
    assert len(got) == 3000


def test_hash_rank(spark):
    rows = skewed(spark)
    got = ordering.hash_rank(rows, ["g"], hash_order(42, F.col("id")), ["id"], "rank").collect()
    by_group = defaultdict(list)
    for r in got:
        by_group[r["g"]].append((hashlib.md5(f"42:{r['id']}".encode()).hexdigest(), r["rank"]))
    for items in by_group.values():
        assert [rank for _, rank in sorted(items)] == list(range(1, len(items) + 1))


@pytest.mark.parametrize("want", [0, 1, 300, 400, 5000])
@pytest.mark.parametrize("n", [1, 17, 3000])
def test_take_lowest_is_exact(spark, n, want):
    rows = skewed(spark, n)
    got = ordering.take_lowest(rows, ["g"], hash_order(42, F.col("id")), lambda n: F.least(n, F.lit(want)))
    assert {tuple(r) for r in got.collect()} == lowest(rows.collect(), lambda n: min(n, want))


def test_take_lowest_of_all_rows(spark):
    rows = skewed(spark, 500)
    got = ordering.take_lowest(rows, [], hash_order(42, F.col("id")), lambda n: F.lit(123))
    all_rows = [(r["id"], 0) for r in rows.collect()]
    assert {r["id"] for r in got.collect()} == {k for k, _ in lowest(all_rows, lambda n: 123)}
    assert got.columns == rows.columns


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_sample_does_not_depend_on_partitions(spark, partitions):
    rows = skewed(spark).repartition(partitions)
    got = sample.stratified_sample(rows, "g", 100, 10, ["id"])
    assert {tuple(r) for r in got.collect()} == lowest(rows.collect(), lambda n: min(n, 100))


def test_copies_of_one_key_do_not_break_the_count(spark):
    # two thirds of the rows share one key, and their hash may lie on either side
    for seed in range(4):
        rows = spark.range(3000).select(
            F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("key"), F.col("id"), F.lit("a").alias("g")
        )
        got = ordering.take_lowest(
            rows, ["g"], hash_order(seed, F.col("key")), lambda n: F.least(n, F.lit(700))
        )
        assert got.count() == 700 and got.distinct().count() == 700


def test_null_group_is_kept(spark):
    rows = spark.range(50).select("id", F.when(F.col("id") < 20, "a").alias("g"))
    got = sample.stratified_sample(rows, "g", 15, 0, ["id"])
    assert got.groupBy("g").count().count() == 2 and got.count() == 30


def test_mark_lowest(spark):
    rows = skewed(spark)
    got = ordering.mark_lowest(rows, ["g"], hash_order(42, F.col("id")), lambda n: F.ceil(n * 0.2), "hit").collect()
    assert {(r["id"], r["g"]) for r in got if r["hit"]} == lowest(rows.collect(), lambda n: -(-n // 5))
    assert len(got) == 3000


def test_mark_lowest_keeps_copies_together(spark):
    rows = spark.range(1000).select(F.pmod("id", F.lit(50)).alias("key"), "id")
    got = ordering.mark_lowest(rows, [], hash_order(1, F.col("key")), lambda n: F.ceil(n * 0.3), "hit")
    sides = got.groupBy("key").agg(F.countDistinct("hit").alias("n")).filter("n > 1")
    assert sides.count() == 0 and got.filter("hit").count() == 300


def counted(spark, rows):
    """The rows, and an accumulator of how many were read over all passes."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return rows.mapInPandas(run, rows.schema), seen


def test_samples_pass_twice_and_splits_three_times_over_the_rows(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    source, seen = counted(spark, rows)
    got = ordering.take_lowest(source, ["g"], hash_order(1, F.col("id")), lambda n: F.least(n, F.lit(50)))
    assert got.count() == 100 and seen.value <= 2 * 2000
    source, seen = counted(spark, rows)
    marked = ordering.mark_lowest(source, ["g"], hash_order(1, F.col("id")), lambda n: F.ceil(n * 0.2), "hit")
    assert marked.filter("hit").agg(F.count("id")).first()[0] == 134 + 267 and seen.value <= 3 * 2000
