"""Navigation maps: memberships, entry points, presentation order, id repair, retrieval cases, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

ROLES = ("core", "current", "supporting", "tension", "context")


def role_rank(role: Column) -> Column:
    out = F.lit(len(ROLES))
    for k, name in enumerate(ROLES):
        out = F.when(role == name, k).otherwise(out)
    return out


def assemble(proposed: DataFrame, seeds: DataFrame, core: int = 12, current: int = 8) -> DataFrame:
    """(group_id, node_id, role, is_current) from proposals (``group_id, node_id, role, is_current, salience``) and core seeds (``group_id, node_id``).

    A node proposed twice keeps its first role by rank and any current mark; seeds are core. Each group keeps its ``core`` best core nodes (the
    others become supporting) and ``current`` best current marks.
    """
    s = seeds.select("group_id", "node_id", F.lit(True).alias("seed")).distinct()
    agg = proposed.groupBy("group_id", "node_id").agg(F.min(role_rank(F.col("role"))).alias("k"), F.bool_or("is_current").alias("c"), F.max("salience").alias("salience"))
    j = agg.join(s, ["group_id", "node_id"], "left").withColumn("k", F.when(F.coalesce("seed", F.lit(False)), 0).otherwise(F.col("k")))
    order = (F.desc("salience"), F.col("node_id"))
    rank = lambda cond: F.row_number().over(Window.partitionBy("group_id", cond).orderBy(*order))
    r = j.withColumn("core_rank", rank(F.col("k") == 0)).withColumn("current_rank", rank(F.col("c")))
    k = F.when((F.col("k") == 0) & (F.col("core_rank") > core), ROLES.index("supporting")).otherwise(F.col("k"))
    return r.select("group_id", "node_id", F.get(F.array(*map(F.lit, ROLES)), k).alias("role"), (F.col("c") & (F.col("current_rank") <= current)).alias("is_current"))


def entry_points(groups: DataFrame, top: int = 6) -> DataFrame:
    """The ``top`` groups that are a direction, by salience (``group_id, role, salience``)."""
    return groups.where("role = 'core_direction'").orderBy(F.desc("salience"), "group_id").limit(top).select("group_id")


def recency_order() -> list[Column]:
    """Last seen, first seen (newest first), then title and id."""
    return [F.col("last_seen").desc_nulls_last(), F.col("first_seen").desc_nulls_last(), F.col("title").asc(), F.col("node_id").asc()]


def latest_claims(claims: DataFrame, current: DataFrame, top: int = 3) -> DataFrame:
    """Each node's claims for display: those of its current state first, then by time and chronology, newest first.

    A claim is known by its node and number: ids have four digits and repeat from a node's ten-thousandth claim on.
    """
    j = claims.join(current.select("canonical_key", "claim_no", F.lit(1).alias("cur")), ["canonical_key", "claim_no"], "left").na.fill(0, ["cur"])
    r = F.row_number().over(Window.partitionBy("canonical_key").orderBy(F.desc("cur"), F.col("time_unix").desc_nulls_last(), F.desc("chronology_index"), "claim_id"))
    return j.withColumn("rank", r.cast("long")).where(F.col("rank") <= top).select("canonical_key", "claim_id", "rank", "cur")


def repaired_ids(given: DataFrame, valid: DataFrame) -> DataFrame:
    """``id`` with the valid id it means: itself, or the only valid id with its first two parts, or the only one with its last part; else null."""
    v = valid.select(F.col("id").alias("v")).distinct()
    only = lambda key: v.groupBy(key.alias("p")).agg(F.count("*").alias("n"), F.first("v").alias("m")).where("n = 1").drop("n")
    prefix, suffix = T.id_prefix(F.col("v")), F.substring_index("v", ":", -1)
    by_prefix, by_suffix = only(prefix).withColumnsRenamed({"p": "p1", "m": "m1"}), only(suffix).withColumnsRenamed({"p": "p2", "m": "m2"})
    g = given.select("id").distinct()
    j = g.join(v, F.col("id") == F.col("v"), "left").join(by_prefix, T.id_prefix(F.col("id")) == F.col("p1"), "left").join(by_suffix, F.substring_index("id", ":", -1) == F.col("p2"), "left")
    return j.select("id", F.coalesce("v", "m1", "m2").alias("valid_id"))


def retrieval_cases(groups: DataFrame, nodes: DataFrame, evidence: DataFrame, top: int = 16, sources: int = 4) -> DataFrame:
    """Questions that an export must answer: for entry groups, current nodes and written sources, with what is expected."""
    g = groups.select(F.concat(F.lit("constellation:"), "group_id").alias("question_id"), F.concat_ws(" ", F.lit("main ideas of"), "title").alias("question"), F.col("group_id").alias("expected"))
    n = nodes.orderBy(F.desc("salience"), "node_id").limit(top).select(F.concat(F.lit("node:"), "node_id").alias("question_id"), F.concat_ws(" ", F.lit("sources on"), "title").alias("question"), F.col("node_id").alias("expected"))
    e = evidence.orderBy("segment_id").limit(sources).select(F.concat(F.lit("source:"), "segment_id").alias("question_id"), F.concat_ws(" ", F.lit("original words of"), "document_id").alias("question"), F.col("node_id").alias("expected"))
    return g.unionByName(n).unionByName(e)


def hash_unit(x: Column) -> Column:
    """A stable number from 0 up to 1 for layout jitter."""
    return F.pmod(F.xxhash64(x), F.lit(1 << 30)) / float(1 << 30)


def layout(members: DataFrame, spacing: float = 1.0) -> DataFrame:
    """(node_id, x, y): nodes of a group on a sunflower spiral by salience around the group's own place on a larger one."""
    golden = 2.399963229728653
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n"))
    g = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "group_id")) - 1)  # one row a group: tens, not nodes
    at = g.select("group_id", (F.cos(F.col("k") * golden) * F.sqrt("k") * 12 * spacing).alias("gx"), (F.sin(F.col("k") * golden) * F.sqrt("k") * 12 * spacing).alias("gy"))
    r = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("salience"), "node_id")) - 1
    m = members.withColumn("r", r).join(at, "group_id")
    return m.select("group_id", "node_id", F.round(F.col("gx") + F.cos(F.col("r") * golden) * F.sqrt("r") * spacing, 4).alias("x"), F.round(F.col("gy") + F.sin(F.col("r") * golden) * F.sqrt("r") * spacing, 4).alias("y"))


def dossiers(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """``name, body`` pages: a heading, the summary and the quoted evidence of each node."""
    quotes = evidence.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("> "), F.regexp_replace(x["text"], "\n", "\n> "))), "\n\n").alias("quotes"))
    j = nodes.join(quotes, "node_id", "left")
    return j.select(F.col("node_id").alias("name"), F.concat_ws("\n\n", F.concat(F.lit("## "), "title"), F.concat(F.lit("ID: "), "node_id"), "summary", "quotes").alias("body"))
