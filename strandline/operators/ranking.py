"""A global rank without a single task: range partitions, ranks inside them, and one offset a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import cut


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based position in ``order``, which must be total. Only one count per partition is gathered in one place.

    The rows are written first: choosing the ranges reads them a second time.
    """
    ranged = cut(df, "unranked").repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut(ranged.withColumn("__m", F.monotonically_increasing_id()), "rank")
    at = F.shiftright("__m", 33)
    sizes = marked.groupBy(at.alias("__p")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__o"))
    joined = marked.withColumn("__p", at).join(F.broadcast(offsets), "__p")  # one row a partition
    return joined.withColumn(name, F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1).drop("__p", "__o", "__m")
