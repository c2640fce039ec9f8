"""Graph operators over ``nodes`` and ``edges``: components, degrees, neighbours, contraction, propagation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..plans.storage import cut

POSITIVE = ("semantic_related", "supports", "revises", "supersedes")
BLOCKING = ("tensions_with", "context_split")
REVISION = ("revises", "supersedes")


#: Nodes that a worker holds before it gives its stars.
HELD = 200_000


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's edges as stars around the smallest node of each of its own components, which shortens all paths; some ``HELD`` nodes are held at once, and stars of one
    component that come apart still share nodes."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars() -> Iterator[pd.DataFrame]:
        nodes = list(root)
        for k in range(0, len(nodes), 50_000):
            yield pd.DataFrame({"a": nodes[k : k + 50_000], "b": [find(x) for x in nodes[k : k + 50_000]]})

    for batch in batches:
        if len(root) >= HELD:
            yield from stars()
            root.clear()
        for x, y in zip(batch["a"], batch["b"], strict=True):
            root.setdefault(x, x)
            root.setdefault(y, y)
            x, y = find(x), find(y)
            if x < y:
                root[y] = x
            elif y < x:
                root[x] = y
    yield from stars()


def connected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, root): the smallest node of each component, by smallest labels and pointer jumping; every round ends in a written table."""
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    one = one.mapInPandas(_stars, one.schema)
    both = cut(one.selectExpr("inline(array(struct(a, b), struct(b AS a, a AS b)))").distinct(), "cc-edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        up = low.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        after = cut(low.join(up, F.col("root") == F.col("n2"), "left").select("node", "was", F.least("root", F.coalesce("r2", "root")).alias("root")), "cc")
        labels = after.select("node", "root")
        if after.where("was <> root").isEmpty():
            return labels


def components(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    """(node_id, root, size) of every node, isolated ones included."""
    roots = connected(edges)
    all_ = nodes.select(F.col(node).alias("node_id")).join(roots, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("root", "node_id").alias("root"))
    sizes = all_.groupBy("root").agg(F.count("*").alias("size"))
    return all_.join(sizes, "root").select("node_id", "root", "size")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(*(F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns)))


def related(edges: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(node, neighbour) pairs of either direction, distinct, without loops."""
    e = edges.where(F.col("type").isin(*kinds)) if kinds else edges
    return both_ways(e.select("src", "dst")).where("src <> dst").distinct().select(F.col("src").alias("node"), F.col("dst").alias("nbr"))


def degrees(edges: DataFrame) -> DataFrame:
    return related(edges).groupBy("node").agg(F.count("*").alias("degree"))


def shared_neighbours(edges: DataFrame, least: int = 2, also: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, jaccard) of pairs with ``least`` common positive neighbours, and of the pairs ``also`` (a, b) with one, each pair once, without what they are to each other.

    Two nodes with ``least`` common neighbours still share one if each leaves out its ``least - 1`` busiest neighbours, so pairs arise from the
    others alone: the hub that most nodes know gives none. Their neighbour sets are then compared whole.
    """
    nbr = cut(related(edges, POSITIVE), "positive")
    sets = cut(nbr.groupBy("node").agg(F.collect_set("nbr").alias("ns"), F.count("*").alias("deg")), "neighbour-sets")
    busy = nbr.join(sets.select(F.col("node").alias("nbr"), "deg"), "nbr")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("deg"), "nbr"))
    few = cut(busy.withColumn("r", rank).where(F.col("r") >= least).select("node", "nbr"), "rarer-neighbours")
    pairs = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "nbr").where("a < b").select("a", "b").distinct()
    if also is not None:
        pairs = pairs.withColumn("own", F.lit(False)).unionByName(also.select("a", "b").where("a < b").withColumn("own", F.lit(True))).groupBy("a", "b").agg(F.bool_or("own").alias("own"))
    else:
        pairs = pairs.withColumn("own", F.lit(False))
    one, two = sets.select(F.col("node").alias("a"), F.col("ns").alias("na")), sets.select(F.col("node").alias("b"), F.col("ns").alias("nb"))
    both = pairs.join(one, "a").join(two, "b").selectExpr("a", "b", "own", "cast(size(array_intersect(na, nb)) AS bigint) AS shared", "size(na) + size(nb) - 2 * int(array_contains(na, b)) AS all")
    return both.where((F.col("shared") >= least) | F.col("own") & (F.col("shared") > 0)).select("a", "b", "shared", (F.col("shared") / (F.col("all") - F.col("shared"))).alias("jaccard"))


def pair_summaries(edges: DataFrame) -> DataFrame:
    """Weights by class of relation for each unordered pair."""
    of = lambda ks: F.sum(F.when(F.col("type").isin(*ks), F.col("weight")).otherwise(0)).alias
    pairs = edges.where("src <> dst").withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    return pairs.groupBy("a", "b").agg(of(("semantic_related", "supports"))("semantic"), of(REVISION)("revision"), of(BLOCKING)("blocking"), F.array_sort(F.collect_set("type")).alias("types"))


def reciprocal_losers(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = REVISION) -> DataFrame:
    """Of two opposite directed edges the one that goes: newer -> older stays, by (last_seen, first_seen, weight, id)."""
    seen = nodes.select("node_id", "first_seen", "last_seen")
    e = edges.where(F.col("type").isin(*kinds)).join(seen, F.col("src") == F.col("node_id")).drop("node_id")
    e = e.select("edge_id", "src", "dst", "type", F.struct(F.coalesce("last_seen", F.lit(-1)).alias("l"), F.coalesce("first_seen", F.lit(-1)).alias("f"), "weight", "edge_id").alias("rank"))
    o = e.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "type", F.col("rank").alias("other"))
    return e.join(o, ["src", "dst", "type"]).where("rank < other").select("edge_id")


def contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between groups: ends replaced (``node_id, family_id``), loops dropped, weights added, supports united."""
    m1, m2 = mapping.select(F.col("node_id").alias("src"), F.col("family_id").alias("fs")), mapping.select(F.col("node_id").alias("dst"), F.col("family_id").alias("fd"))
    return grouped(edges.join(m1, "src").join(m2, "dst").where("fs <> fd"))


def grouped(joined: DataFrame) -> DataFrame:
    """Edges with new ends ``fs`` and ``fd``: symmetric ones in order, weights added, supports united."""
    symmetric = F.col("type").isin("co_occurs", "semantic_related", "tensions_with", "context_split")
    a, b = F.when(symmetric, F.least("fs", "fd")).otherwise(F.col("fs")), F.when(symmetric, F.greatest("fs", "fd")).otherwise(F.col("fd"))
    rows = joined.select("type", a.alias("src"), b.alias("dst"), "weight", "segments")
    return rows.groupBy("type", "src", "dst").agg(F.sum("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("segments")))).alias("segments"))


def strongest_edges(edges: DataFrame) -> DataFrame:
    """For each node and neighbour the edge with the highest priority of type, then weight, then id; with its direction."""
    kinds = ["revises", "supersedes", "tensions_with", "context_split", "supports", "semantic_related", "co_occurs"]
    prio = F.lit(0)
    for k, name in enumerate(reversed(kinds)):
        prio = F.when(F.col("type") == name, k + 1).otherwise(prio)
    ways = edges.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr"), F.lit("in").alias("way")))).alias("w"), "type", "weight", "edge_id", prio.alias("prio")).select("w.*", "type", "weight", "edge_id", "prio")
    best = F.row_number().over(Window.partitionBy("node", "nbr").orderBy(F.desc("prio"), F.desc("weight"), "edge_id", "way"))
    return ways.withColumn("r", best).where("r = 1").select("node", "nbr", "way", "type", "weight")


def relation_weight(kind: Column, weight: Column) -> Column:
    """log2(1 + w), more for revisions and less for co-occurrence, at least .25."""
    scale = F.when(kind.isin(*REVISION), 1.35).when(kind == "co_occurs", 0.55).otherwise(1.0)
    return F.greatest(F.lit(0.25), F.log2(1 + weight) * scale)


def propagate(labels: DataFrame, edges: DataFrame, passes: int = 2, own: float = 1.0) -> DataFrame:
    """Synchronous label propagation: each node takes the label with the largest sum of edge weights, its own counting ``own``; ties to the smaller label."""
    w = both_ways(edges.select("src", "dst", "w"))
    for _ in range(passes):
        votes = w.join(labels, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "label", "w").unionByName(labels.select("node", "label", F.lit(own).alias("w")))
        sums = votes.groupBy("node", "label").agg(F.round(F.sum("w"), 6).alias("w"))
        labels = cut(sums.groupBy("node").agg(F.max_by("label", F.struct("w", F.lit(0))).alias("x"), F.min(F.struct((-F.col("w")).alias("v"), "label"))["label"].alias("label")).select("node", "label"), "labels")
    return labels


def repair_by_vote(assigned: DataFrame, missing: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """``missing`` nodes take the group most of their neighbours are in, if it has ``least`` votes and more than the next; one pass."""
    near = related(edges).join(missing.select(F.col("node_id").alias("node")), "node").join(assigned.select(F.col("node_id").alias("nbr"), "group_id"), "nbr")
    votes = near.groupBy("node", "group_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("node").orderBy(F.desc("n"), "group_id")
    top = votes.select("*", F.row_number().over(w).alias("r"), F.coalesce(F.lead("n").over(w), F.lit(0)).alias("next"))
    return top.where((F.col("r") == 1) & (F.col("n") >= least) & (F.col("n") > F.col("next"))).select(F.col("node").alias("node_id"), "group_id", F.col("n").alias("votes"))


def family_id(members: Column, key: Column) -> Column:
    return F.concat(F.lit("consolidated:"), T.set_hash(members, 12), F.lit(":"), key)
