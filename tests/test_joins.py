import pytest
from pyspark.sql import functions as F

from flowlab.functions.labels import class_table
from flowlab.operators import joins


def logs(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], "uid string, ts int")
    http = spark.createDataFrame([("a", 10, "GET"), ("a", 11, "PUT"), (None, 12, "X")], "uid string, ts int, method string")
    dns = spark.createDataFrame([("b", 20, "q", "m")], "uid string, ts int, query string, method string")
    return base, http, dns


def test_merge_fans_out_and_names_clashes(spark):
    base, http, dns = logs(spark)
    got = joins.merge_logs(base, {"http": http, "dns": dns})
    assert got.columns == ["uid", "ts", "ts_http", "method", "ts_dns", "query", "method_dns"]
    rows = sorted(map(tuple, got.collect()), key=lambda r: (r[1], r[2] or 0))
    assert [r[:4] for r in rows] == [("a", 1, 10, "GET"), ("a", 1, 11, "PUT"), ("b", 2, None, None),
                                     (None, 3, None, None), ("c", 4, None, None)]
    assert rows[2][4:] == (20, "q", "m")


def test_null_keys_match_only_when_asked(spark):
    base, http, _ = logs(spark)
    got = joins.merge_logs(base, {"http": http}, null_safe=True).filter("uid is null").collect()
    assert [tuple(r) for r in got] == [(None, 3, 12, "X")]


def hot_tables(spark):
    base = spark.range(60).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("uid"),
        F.col("id").alias("row"),
    )
    # many exact copies of a row of one key, and NULL keys
    http = spark.range(300).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("uid"),
        F.pmod("id", F.lit(4)).alias("x"),
    )
    dns = spark.range(12).select(F.when(F.col("id") < 6, "hot").otherwise(F.col("id").cast("string")).alias("uid"), F.col("id").alias("y"))
    ssl = spark.range(5).select(F.lit("none of these").alias("uid"), F.col("id").alias("z"))
    return base, {"http": http, "dns": dns, "ssl": ssl}


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("heavy_rows", [1, 7, 40, 10**6])
def test_hot_keys_give_the_same_rows(spark, null_safe, heavy_rows):
    base, logs = hot_tables(spark)
    plain = base
    for name, log in logs.items():
        other = log.withColumnRenamed("uid", f"_{name}")
        on = plain["uid"].eqNullSafe(other[f"_{name}"]) if null_safe else plain["uid"] == other[f"_{name}"]
        plain = plain.join(other, on, "left").drop(f"_{name}")
    key = lambda r: tuple((v is None, v) for v in r)
    got = joins.merge_logs(base, logs, null_safe=null_safe, heavy_rows=heavy_rows)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_hot_keys_are_spread_and_the_base_is_scanned_once(spark, tmp_path):
    base, logs = hot_tables(spark)
    base.write.parquet(str(tmp_path / "base"))
    stored = spark.read.parquet(str(tmp_path / "base"))
    got = joins.merge_logs(stored, logs, heavy_rows=10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [uid") + plan.count("Relation [row") <= 1 + plan.count("Relation [_key")
    tally = {r["_key"]: r for r in joins.hot_keys(stored, list(logs.values()), "uid", False, 10).collect()}
    assert set(tally) == {"hot"} and (tally["hot"]["m0"], tally["hot"]["n0"], tally["hot"]["m1"]) == (20, 150, 3000)


def test_dictionary_joins(spark):
    rows = spark.createDataFrame([(1, " xss"), (2, "what"), (3, None), (4, "what")], "id int, label string")
    dim = class_table(spark)
    got = {r["id"]: r["label_str"] for r in joins.map_labels(rows, dim, "label").collect()}
    assert got == {1: "WebAttack", 2: "", 3: "", 4: ""}
    unknown = {r["label"]: r["rows"] for r in joins.unmapped_labels(rows, dim, "label").collect()}
    assert unknown == {"what": 2, None: 1}
    assert [r["id"] for r in joins.keep_mapped(rows, dim, "label").collect()] == [1]


def test_missing_sessions(spark):
    log = spark.createDataFrame([("A", 1, 40), ("A", 2, 39), ("B", 1, 40)], "condition string, run int, server_round int")
    plan = joins.planned_sessions(log.select("condition").distinct(), 2)
    got = sorted(map(tuple, joins.missing_sessions(plan, log, 40).collect()))
    assert got == [("A", 2), ("B", 2)]


def test_hot_keys_from_summaries_match_exact_counts(spark):
    import random
    from collections import Counter

    from flowlab.operators import joins as J

    rng = random.Random(5)
    # key 1 is hot alone, keys 2 and 3 only through fan-out over three tables
    base = [1] * 400 + [2] * 30 + [3] * 25 + [rng.randint(10, 5000) for _ in range(3000)] + [None] * 50
    log1 = [1] + [2] * 30 + [3] * 20 + [rng.randint(10, 5000) for _ in range(3000)]
    log2 = [2] * 5 + [rng.randint(10, 5000) for _ in range(2000)] + [None] * 9
    frames = [spark.createDataFrame([(k,) for k in t], "uid long").repartition(7) for t in (base, log1, log2)]
    heavy = 300
    got = {r["_key"]: tuple(r[c] for c in ("m0", "n0", "m1", "n1")) for r in
           J.hot_keys(frames[0], frames[1:], "uid", False, heavy).collect()}
    counts = [Counter(k for k in t if k is not None) for t in (base, log1, log2)]
    want = {}
    for k in counts[0]:
        m0, n0, n1 = counts[0][k], counts[1].get(k, 0), counts[2].get(k, 0)
        m1 = m0 * max(1, n0)
        if (n0 > 0 and max(n0, m0) > heavy) or (n1 > 0 and max(n1, m1) > heavy):
            want[k] = (m0, n0, m1, n1)
    assert got == want and set(want) == {1, 2}
