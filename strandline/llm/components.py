"""Connected components by smallest label with pointer jumping; each round ends in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected(edges: DataFrame, tag: str) -> DataFrame:
    """``edges`` (a, b), either direction, self-loops and repeats allowed -> (node, root): the smallest node of its component.

    A hub's label is one row on its side of the join, so a hub with any number of edges splits like any skewed join; smallest
    labels are pre-aggregated before the shuffle. Null ends are left out.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = cut(both.selectExpr("inline(array(struct(a, b), struct(b AS a, a AS b)))").distinct(), f"{tag}-edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{tag}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        after = cut(low.join(up, F.col("root") == F.col("n2"), "left").select("node", "was", F.least("root", F.coalesce("r2", "root")).alias("root")), f"{tag}-{step}")
        labels = after.select("node", "root")
        if after.where("was <> root").isEmpty():
            return labels
