import os

from flowlab.operators.sample import stratified_sample
from flowlab.scratch import materialize, scratch_root, scratch_scope


def test_scope_removes_its_tables_only(spark, tmp_path):
    kept = materialize(spark.range(3), "kept")
    root = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    with scratch_scope(spark):
        rows = spark.range(500).selectExpr("id", "id % 3 as label")
        stratified_sample(rows, "label", 10, 0, ["id"]).write.parquet(str(tmp_path / "out"))
        assert set(os.listdir(root)) > before
    assert set(os.listdir(root)) == before and kept.count() == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
