"""Queries on upkeep: orders, hints, pages, scopes, kept ids, sanitised proposals and the audits of maps and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, families, incremental, ranking, retrieval, salience
from ..streaming import events as S
from . import base, graph


def document_keywords(spark, sf_dir):
    w = base.writings(spark, sf_dir)
    return w.select("document_id", F.md5(F.array_join(T.keywords(F.col("title")), " ")).alias("keywords_md5"))


def relation_keys(spark, sf_dir):
    """Edges by their key, which orders the ends of symmetric relations only."""
    e = graph._edges(spark, sf_dir)
    return e.select(T.relation_key(F.col("type"), F.col("dst"), F.col("src")).alias("relation_key"), "weight")


def role_gaps(spark, sf_dir):
    """Memberships with no role or several, of nodes that have none where their status is tentative and two where they are questions."""
    n = graph._nodes(spark, sf_dir)
    m = n.select(F.substring("canonical_key", 1, 1).alias("group_id"), "node_id", F.when(F.col("status") == "active", "core").alias("role"))
    more = n.where("node_type = 'question'").select(F.substring("canonical_key", 1, 1).alias("group_id"), "node_id", F.lit("tension").alias("role"))
    return audit.roles_partition(m.unionByName(more))


def sliding_counts(spark, sf_dir):
    t = S.tumbling(base.table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,4)")), width="2 days", slide="1 day")
    return t.select(F.date_format("started", "yyyy-MM-dd").alias("day"), "event_type", "n_events", F.col("total").cast("double").alias("total"))


def pairs_in_scope(spark, sf_dir):
    """Family pairs with an end that several claims support."""
    n = graph._nodes(spark, sf_dir)
    pairs = graph.family_pairs(spark, sf_dir)
    return families.in_scope(pairs, n.where("n_claims > 2").select("node_id"))


def unknown_targets(spark, sf_dir):
    """Candidates that point at a key which no node has after tentative candidates are gone."""
    c = graph._cands(spark, sf_dir)
    return audit.unknown(c.where("target_key IS NOT NULL").select("candidate_id", "target_key"), c.where("status = 'active'"), "target_key", "canonical_key").select("candidate_id", "target_key")


def omitted_nodes(spark, sf_dir):
    """Nodes of some salience that no group of supported nodes has."""
    a = graph._assessed(spark, sf_dir)
    chosen = graph._nodes(spark, sf_dir).where("n_claims > 1").select("node_id")
    return salience.omissions(a, chosen, 55.0)


def misordered_batches(spark, sf_dir):
    """Places of batches whose output is not the item asked for, where every ninth turn comes back as another one and every tenth not at all."""
    t = base.turns(spark, sf_dir).select(F.col("conversation_id").alias("batch_id"), "ord", F.concat_ws("#", "conversation_id", F.col("ord").cast("string")).alias("input_id"))
    back = t.where("length(input_id) % 10 <> 0").withColumn("input_id", F.when(F.col("ord") % 9 == 4, "other").otherwise(F.col("input_id")))
    return audit.batch_order(t, back)


def strange_trajectories(spark, sf_dir):
    """Trajectories of a document's candidates that are too short or long, or come back to a node."""
    c = graph._cands(spark, sf_dir)
    stages = c.select(F.col("document_id").alias("trajectory_id"), "candidate_id", F.col("canonical_key").alias("node_id"))
    return audit.trajectories(stages, c.where("status = 'active'").select(F.col("canonical_key").alias("node_id")))


def kept_family_ids(spark, sf_dir):
    """Families by first letter rebuilt by first two: which keep their old id."""
    n = graph._nodes(spark, sf_dir)
    old = n.select(F.substring("canonical_key", 1, 2).alias("family_id"), "node_id")
    new = n.where("n_documents > 1").select(F.concat(F.lit("new:"), F.substring("canonical_key", 1, 3)).alias("family_id"), "node_id")
    return incremental.keep_ids(old, new)


def spliced_families(spark, sf_dir):
    n = graph._nodes(spark, sf_dir).select("node_id", F.substring("canonical_key", 1, 1).alias("family_id"), "n_claims")
    touched = n.where("n_claims > 9").select("family_id")
    rebuilt = n.join(touched.distinct(), "family_id", "left_semi").select("node_id", "family_id", (F.col("n_claims") + 1).alias("n_claims"))
    return incremental.splice(n, rebuilt, touched)


def pack_places(spark, sf_dir):
    """The place of every node in a knowledge pack."""
    return ranking.global_rank(graph._assessed(spark, sf_dir).select("node_id", "authority", "salience"), retrieval.pack_order(None), "place").select("node_id", "place")


def node_hints(spark, sf_dir):
    """The 60 nodes with most evidence, which a provider is told of."""
    return graph._nodes(spark, sf_dir).orderBy(F.desc("n_claims"), "node_id").limit(60).select("node_id", "n_claims")


def group_edges(spark, sf_dir):
    """Between groups: relations, their weight, and the type with most weight (of equal ones the first by name)."""
    e = graph._edges(spark, sf_dir)
    side = lambda c: F.substring(c, 9, 1)
    rows = e.select(F.least(side("src"), side("dst")).alias("a"), F.greatest(side("src"), side("dst")).alias("b"), "type", "weight").where("a <> b")
    per = rows.groupBy("a", "b", "type").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return per.groupBy("a", "b").agg(F.sum("n").alias("n_edges"), F.sum("w").alias("weight"), F.min_by("type", F.struct((-F.col("w")).alias("w"), "type")).alias("main_type"))


def top_edges(spark, sf_dir):
    """The graph page's list of heaviest edges."""
    return graph._edges(spark, sf_dir).orderBy(F.desc("weight"), "edge_id").limit(25).select("edge_id", "weight")


def top_components(spark, sf_dir):
    """The graph page's list of largest components."""
    c = graph.connected_components(spark, sf_dir)
    return c.select("root", "size").distinct().orderBy(F.desc("size"), "root").limit(25)


def node_pages(spark, sf_dir):
    """Pages of 200 nodes by title and id."""
    n = ranking.global_rank(graph._nodes(spark, sf_dir).select("node_id", "title"), [F.col("title").asc(), F.col("node_id").asc()], "place")
    return n.select("node_id", F.floor((F.col("place") - 1) / 200).alias("page"))


def document_order(spark, sf_dir):
    """Documents by their first time, undated ones last, then by id."""
    d = base.segments(spark, sf_dir).groupBy("document_id").agg(F.min("time_unix").alias("time_unix"))
    return ranking.global_rank(d, [F.col("time_unix").asc_nulls_last(), F.col("document_id").asc()], "place").select("document_id", "place")


def proposals(spark, sf_dir):
    """Relations that candidates propose: slug keys, none to itself, the last of a segment's for one target."""
    c = graph._cands(spark, sf_dir).where("target_key IS NOT NULL")
    slug = c.select("segment_id", "ord", T.slugify(F.col("canonical_key")).alias("key"), T.slugify(F.col("target_key")).alias("target"), "relation").where("key <> target AND key <> '' AND target <> ''")
    return slug.groupBy("segment_id", "key", "target").agg(F.max_by("relation", "ord").alias("relation"))


QUERIES = {
    f.__name__: f
    for f in (
        document_keywords, relation_keys, role_gaps, sliding_counts, pairs_in_scope, unknown_targets, omitted_nodes, misordered_batches, strange_trajectories, kept_family_ids, spliced_families, pack_places, node_hints,
        group_edges, top_edges, top_components, node_pages, document_order, proposals,
    )
}

_SYMMETRIC = "type IN ('co_occurs', 'semantic_related', 'tensions_with', 'context_split')"
SQL = {
    "document_keywords": base.sql(f"SELECT 'writing:' || doc_id AS document_id, md5(array_to_string(list_sort(list_distinct({base.words_sql("coalesce(ls[1], '')", 2)})), ' ')) AS keywords_md5 FROM w_lines", "w_lines"),
    "relation_keys": base.sql(f"SELECT CASE WHEN {_SYMMETRIC} THEN type || ':' || least(src, dst) || ':' || greatest(src, dst) ELSE type || ':' || dst || ':' || src END AS relation_key, weight FROM edge", "edge"),
    "role_gaps": base.sql("SELECT substr(canonical_key, 1, 1) AS group_id, node_id FROM node WHERE (CASE WHEN status = 'active' THEN 1 ELSE 0 END) + (CASE WHEN node_type = 'question' THEN 1 ELSE 0 END) <> 1", "node"),
    "sliding_counts": "SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(*) AS n_events, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM (SELECT event_type, value, date_trunc('day', ts) - to_days(k) AS day FROM events, (VALUES (0), (1)) AS s(k)) GROUP BY 1, 2",
    "pairs_in_scope": graph.SQL["family_pairs"].replace("SELECT a, b, reason FROM (SELECT a, b, CASE", "SELECT a, b, reason FROM (SELECT a, b, a IN (SELECT node_id FROM node WHERE n_claims > 2) OR b IN (SELECT node_id FROM node WHERE n_claims > 2) AS near, CASE").replace("WHERE reason IS NOT NULL", "WHERE reason IS NOT NULL AND near"),
    "unknown_targets": base.sql("SELECT candidate_id, target_key FROM cand WHERE target_key IS NOT NULL AND target_key NOT IN (SELECT canonical_key FROM cand WHERE status = 'active')", "cand"),
    "omitted_nodes": base.sql("SELECT node_id, salience FROM sal WHERE salience >= 55.0 AND node_id NOT IN (SELECT node_id FROM node WHERE n_claims > 1)", "sal"),
    "misordered_batches": "SELECT batch_id, ord FROM (SELECT 'conversation:' || conv_id AS batch_id, turn AS ord, 'conversation:' || conv_id || '#' || turn AS input_id FROM conversations) WHERE length(input_id) % 10 = 0 OR ord % 9 = 4",
    "strange_trajectories": base.sql("""SELECT document_id AS trajectory_id FROM cand GROUP BY document_id HAVING count(*) < 2 OR count(*) > 8 OR count(*) <> count(DISTINCT canonical_key)
UNION SELECT document_id FROM cand WHERE canonical_key NOT IN (SELECT canonical_key FROM cand WHERE status = 'active')""", "cand"),
    "kept_family_ids": base.sql("""SELECT ids.new_id, CASE WHEN a.n = 1 AND b.n = 1 THEN a.old_id ELSE ids.new_id END AS family_id FROM (SELECT DISTINCT new_id FROM kf) ids LEFT JOIN (SELECT new_id, count(DISTINCT old_id) AS n, min(old_id) AS old_id FROM kf GROUP BY new_id) a ON ids.new_id = a.new_id
LEFT JOIN (SELECT old_id, count(DISTINCT new_id) AS n FROM kf GROUP BY old_id) b ON a.old_id = b.old_id""", "node").replace("\nSELECT ids.new_id", ", kf AS (SELECT 'new:' || substr(canonical_key, 1, 3) AS new_id, substr(canonical_key, 1, 2) AS old_id FROM node WHERE n_documents > 1)\nSELECT ids.new_id", 1),
    "spliced_families": base.sql("SELECT node_id, substr(canonical_key, 1, 1) AS family_id, n_claims + CASE WHEN substr(canonical_key, 1, 1) IN (SELECT substr(canonical_key, 1, 1) FROM node WHERE n_claims > 9) THEN 1 ELSE 0 END AS n_claims FROM node", "node"),
    "pack_places": base.sql("SELECT node_id, row_number() OVER (ORDER BY CASE authority WHEN 'mixed' THEN 0 WHEN 'authored' THEN 1 WHEN 'conversation' THEN 2 ELSE 3 END, salience DESC, node_id) AS place FROM sal", "sal"),
    "node_hints": base.sql("SELECT node_id, n_claims FROM node ORDER BY n_claims DESC, node_id LIMIT 60", "node"),
    "group_edges": base.sql("""SELECT a, b, sum(n)::BIGINT AS n_edges, sum(w)::BIGINT AS weight, arg_min(type, (-w, type)) AS main_type FROM (SELECT least(substr(src, 9, 1), substr(dst, 9, 1)) AS a, greatest(substr(src, 9, 1), substr(dst, 9, 1)) AS b, type, count(*) AS n, sum(weight)::BIGINT AS w FROM edge GROUP BY 1, 2, 3) WHERE a <> b GROUP BY a, b""", "edge"),
    "top_edges": base.sql("SELECT edge_id, weight FROM edge ORDER BY weight DESC, edge_id LIMIT 25", "edge"),
    "top_components": graph._cc("SELECT comp AS root, count(*) AS size FROM cc GROUP BY comp ORDER BY size DESC, root LIMIT 25"),
    "node_pages": base.sql("SELECT node_id, (row_number() OVER (ORDER BY title, node_id) - 1) // 200 AS page FROM node", "node"),
    "document_order": base.sql("SELECT document_id, row_number() OVER (ORDER BY min(time_unix) NULLS LAST, document_id) AS place FROM segments GROUP BY document_id", "segments"),
    "proposals": base.sql(f"SELECT segment_id, key, target, arg_max(relation, ord) AS relation FROM (SELECT segment_id, ord, relation, {base.slug_sql('canonical_key')} AS key, {base.slug_sql('target_key')} AS target FROM cand WHERE target_key IS NOT NULL) WHERE key <> target AND key <> '' AND target <> '' GROUP BY 1, 2, 3", "cand"),
}
