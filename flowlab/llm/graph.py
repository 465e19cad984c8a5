"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.scratch import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the smallest node reachable from each node of an edge.

    Every round gives a node the least label among its neighbours, then the label
    of its label, so chains shrink as fast as they double.  Each round is written
    to the scratch folder; only the number of changed rows comes to the driver.
    Loops and repeated edges do no harm, edges with a null end are left out, and
    without edges there are no rows.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        hooked = materialize(labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = materialize(hooked.join(up, "label").select(
            "node", F.least("label", "root").alias("label"), (F.col("old") > F.least("label", "root")).alias("moved")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
