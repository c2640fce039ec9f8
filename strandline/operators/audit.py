"""Data-quality audits: one query per rule, as rows that name what breaks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def issues(**rules: DataFrame) -> DataFrame:
    """(id, code) of all rules; each rule is a DataFrame with an ``id``."""
    return reduce(DataFrame.unionByName, (df.select(F.col("id").cast("string").alias("id"), F.lit(code).alias("code")) for code, df in rules.items()))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count("*").alias("n_issues"), F.count_distinct("id").alias("n_ids"))


def coverage(segments: DataFrame, claims: DataFrame) -> DataFrame:
    """Per kind of source the share of primary segments that a claim rests on; 1 where there is none."""
    hit = claims.select("segment_id").distinct().withColumn("hit", F.lit(1))
    kinds = segments.sparkSession.createDataFrame([("writing",), ("conversation",), ("chat",)], "source_kind string")
    own = segments.where("signal_kind = 'primary'").select("segment_id", "source_kind").join(hit, "segment_id", "left").groupBy("source_kind").agg(F.count("*").alias("n_total"), F.count("hit").alias("n_anchored"))
    return kinds.join(own, "source_kind", "left").na.fill(0).withColumn("share", F.when(F.col("n_total") == 0, 1.0).otherwise(F.col("n_anchored") / F.col("n_total")))


def weak_merges(members: DataFrame, refs: DataFrame) -> DataFrame:
    """Families of several members that rest on one source reference at most."""
    size = members.groupBy("family_id").agg(F.count_distinct("node_id").alias("n_members")).where("n_members > 1")
    anchors = members.join(refs, "node_id").groupBy("family_id").agg(F.count_distinct("segment_id").alias("n_anchors"))
    return size.join(anchors, "family_id", "left").na.fill(0, ["n_anchors"]).where("n_anchors <= 1")


def one_offs(nodes: DataFrame) -> DataFrame:
    """Nodes that stand in one conversation alone."""
    return nodes.where("n_conversation > 0 AND n_writing = 0 AND n_chat = 0 AND n_documents = 1").select("node_id")


def state_growth(stated: DataFrame) -> DataFrame:
    """Nodes with as many states as claims, two at least, of which two in a row are alike in wording (.75)."""
    w = Window.partitionBy("canonical_key").orderBy("claim_no")
    t = stated.withColumn("tok", T.title_tokens(F.col("claim"))).withColumn("next", F.lead("tok").over(w))
    alike = t.withColumn("alike", F.coalesce(T.jaccard(F.col("tok"), F.col("next"), 0.0) >= 0.75, F.lit(False)))
    per = alike.groupBy("canonical_key").agg(F.count("*").alias("n_claims"), F.count_distinct("state_no").alias("n_states"), F.bool_or("alike").alias("alike"))
    return per.where("n_claims >= 2 AND n_states >= 2 AND n_states >= n_claims AND alike").select("canonical_key", "n_claims", "n_states")


def hub_threshold(n: int) -> int:
    return max(12, -(-n * 2 // 100))


def batch_order(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(batch_id, ord) where a batch's output does not have the item that was asked for."""
    j = expected.select("batch_id", "ord", F.col("input_id").alias("want")).join(found.select("batch_id", "ord", F.col("input_id").alias("got")), ["batch_id", "ord"], "full_outer")
    return j.where(~F.col("want").eqNullSafe(F.col("got"))).select("batch_id", "ord")


def density(rows: DataFrame, by: list[str], least_items: int = 3, least_chars: int = 220, wanted: float = 1.5) -> DataFrame:
    """Groups whose long texts (``n_chars``) average too few candidates (``n_candidates``)."""
    long_ = rows.where(F.col("n_chars") >= least_chars)
    per = long_.groupBy(*by).agg(F.count("*").alias("n_long"), F.avg("n_candidates").alias("mean"))
    return per.withColumn("passes", (F.col("n_long") < least_items) | (F.col("mean") >= wanted))


def duplicates(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def unknown(rows: DataFrame, known: DataFrame, col: str, key: str) -> DataFrame:
    """Rows whose reference is not known."""
    return rows.join(known.select(F.col(key).alias(col)).distinct(), col, "left_anti")


def roles_partition(members: DataFrame) -> DataFrame:
    """(group_id, node_id) that have no role or more than one."""
    return members.groupBy("group_id", "node_id").agg(F.count("role").alias("n")).where("n <> 1").select("group_id", "node_id")


def trajectories(stages: DataFrame, members: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """Trajectories (``trajectory_id, stage, node_id``) with too few or many stages, a node twice, or a node that is no member."""
    per = stages.groupBy("trajectory_id").agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("d"))
    strange = stages.join(members.select("node_id").distinct(), "node_id", "left_anti").select("trajectory_id")
    return per.where((F.col("n") < least) | (F.col("n") > most) | (F.col("n") != F.col("d"))).select("trajectory_id").union(strange).distinct()


def attention(report: DataFrame) -> DataFrame:
    """A one-row report with ``share`` and ``errors``: problem, watch or ok."""
    return report.withColumn("level", F.when(F.col("errors") > 0, "problem").when(F.col("share") < 0.9, "watch").otherwise("ok"))
