"""Shared scratch tables: cut lineage, size small sides, survive lost executors.

Intermediate results that are read more than once are written as Parquet to the
folder the cluster names in ``spark.checkpoint.dir``.  Reading them back gives
the planner true file sizes, so a small dimension is broadcast and a large one
is shuffled without any hint from us.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="flowlab-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove all scratch tables made inside, once their results have been written.

        with scratch_scope(spark):
            prepare_flows(...).table.write.parquet(out)
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in made:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back: fixed rows, short lineage, known size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
