from pyspark.sql import functions as F

from flowlab.operators import sample


def rows(spark, n=2000):
    return spark.range(n).select("id", F.when(F.col("id") % 20 == 0, "rare").otherwise("common").alias("label"))


def test_sizes_follow_target_and_minimum(spark):
    def sizes(target, minimum):
        got = sample.stratified_sample(rows(spark), "label", target, minimum, ["id"])
        return {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}

    assert sizes(300, 50) == {"rare": 100, "common": 300}
    assert sizes(10, 50) == {"rare": 50, "common": 50}
    assert sizes(10**6, 1) == {"rare": 100, "common": 1900}


def test_whole_classes(spark):
    got = sample.take_all_or_sample(rows(spark), "label", 20, 0, ["id"], whole=["common"])
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {"rare": 20, "common": 1900}


def test_fraction(spark):
    assert 120 < sample.fraction_sample(rows(spark), 0.1, ["id"]).count() < 280
    assert sample.fraction_sample(rows(spark), 1.0, ["id"]).count() == 2000


def test_splits(spark):
    got = sample.stratified_split(rows(spark), "label", 0.2, ["id"])
    counts = {(r["label"], r["is_test"]): r["count"] for r in got.groupBy("label", "is_test").count().collect()}
    assert counts == {("rare", True): 20, ("rare", False): 80, ("common", True): 380, ("common", False): 1520}
    tail = sample.validation_tail(rows(spark, 1001), 0.1, ["id"])
    assert tail.filter("is_validation").count() == 101


def test_shuffle(spark):
    plain = [r["id"] for r in sample.shuffle_rows(rows(spark), ["id"]).collect()]
    numbered = {r["row"]: r["id"] for r in sample.shuffle_rows(rows(spark), ["id"], index="row").collect()}
    assert plain == [numbered[i] for i in range(2000)] and plain != sorted(plain)
    spread = sample.shuffle_for_training(rows(spark), ["id"], partitions=4)
    assert spread.count() == 2000 and spread.rdd.getNumPartitions() == 4


def test_batches_are_full_and_remainder_is_dropped(spark):
    owned = sample.assign_clients(rows(spark, 1000), 3, "id")
    got = sample.assign_batches(owned, 32, ["id"]).groupBy("client_id", "batch_id").count().collect()
    assert {r["count"] for r in got} == {32}
    assert sorted((r["client_id"], r["batch_id"]) for r in got) == [(c, b) for c in range(3) for b in range(10)]
    hashed = sample.assign_clients(rows(spark, 1000), 3, "label", seed=1)
    assert hashed.select("client_id").distinct().count() <= 2


def test_inject_attacks(spark):
    table = spark.range(500).select(
        "id", (F.col("id") * 1.0).alias("x"), F.col("id").alias("flow_count"), F.pmod("id", F.lit(2)).alias("label")
    )
    got = sample.inject_attacks(table, "label", 100, ["id"])
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {0: 100, 1: 100}
    pairs = got.groupBy("id").agg(
        (F.max("x") / F.min("x")).alias("factor"), F.countDistinct("flow_count").alias("n")
    ).filter("id > 0").agg(F.min("factor"), F.max("factor"), F.max("n")).first()
    assert 3 <= pairs[0] <= 10 and abs(pairs[0] - pairs[1]) < 1e-9 and pairs[2] == 1


def test_peeks(spark):
    assert [r[0] for r in sample.peek_values(rows(spark), "label").collect()] == ["common", "rare"]
    assert [r["id"] for r in sample.peek(rows(spark), 3, ["id"]).collect()] == [0, 1, 2]
