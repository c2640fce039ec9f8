"""Queries on the thought graph: candidates, identities, claims, states, nodes, edges, families, review and maps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import corpus, families, graph, resolve, salience, similarity
from . import base
from .storage import cut, scratch


def _segments(spark, sf_dir):
    return cut(base.segments(spark, sf_dir), "segments")


def _cands(spark, sf_dir, segments=None):
    segments = segments if segments is not None else base.segments(spark, sf_dir)
    return cut(resolve.candidates(segments.where("signal_kind = 'primary' AND source_kind <> 'chat'")), "candidates")


def _claims(spark, sf_dir, cands=None):
    segments = _segments(spark, sf_dir)
    timeline = corpus.timeline(segments.drop("text"))
    return cut(resolve.claims(cands if cands is not None else _cands(spark, sf_dir, segments), timeline), "claims")


def _nodes(spark, sf_dir, cands=None):
    return cut(resolve.nodes(_claims(spark, sf_dir, cands)), "nodes")


def _edges(spark, sf_dir, cands=None):
    return cut(resolve.edges(cands if cands is not None else _cands(spark, sf_dir)), "edges")


def _graph(spark, sf_dir):
    """Candidates, nodes and edges, each made once."""
    c = _cands(spark, sf_dir)
    return c, _nodes(spark, sf_dir, c), _edges(spark, sf_dir, c)


def _docs(spark, sf_dir, cands=None):
    return (cands if cands is not None else _cands(spark, sf_dir)).select(F.concat(F.lit("thought:"), F.col("canonical_key")).alias("node_id"), "document_id", "source_kind").distinct()


def candidate_claims(spark, sf_dir):
    return _cands(spark, sf_dir).select("candidate_id", "segment_id", "document_id", "canonical_key", "node_type", "status", "target_key", "relation", F.md5("claim").alias("claim_md5"))


def identity_pairs(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    rows = n.select(F.col("canonical_key").alias("id"), F.col("canonical_key").alias("key"), "title", "summary", F.col("title").alias("claim"), "node_type")
    return resolve.mergeable_pairs(rows).select("a", "b")


def identity_blocks(spark, sf_dir):
    c = _cands(spark, sf_dir)
    n = _nodes(spark, sf_dir, c)
    rows = n.select(F.col("canonical_key").alias("id"), F.col("canonical_key").alias("key"), "title", "summary", F.col("title").alias("claim"), "node_type")
    vetoes = c.where("target_key IS NOT NULL").select(F.col("canonical_key").alias("a"), F.col("target_key").alias("b")).distinct()
    return resolve.resolve(rows, resolve.mergeable_pairs(rows), vetoes)


def _resolved(spark, sf_dir):
    """Candidates of resolved identities, their claims and nodes."""
    segments = _segments(spark, sf_dir)
    c = _cands(spark, sf_dir, segments)
    timeline = cut(corpus.timeline(segments.drop("text")), "timeline")
    n = cut(resolve.nodes(resolve.claims(c, timeline)), "nodes")
    r = cut(resolve.resolved(c, resolve.identities(n, c)), "resolved")
    return r, cut(resolve.claims(r, timeline), "resolved-claims")


def alias_keys(spark, sf_dir):
    """Which key every candidate key became."""
    r, _ = _resolved(spark, sf_dir)
    return r.select(F.col("alias").alias("key"), "canonical_key").distinct()


def resolved_nodes(spark, sf_dir):
    """Nodes after identity resolution, with the keys and titles that lead to them."""
    r, c = _resolved(spark, sf_dir)
    n = resolve.nodes(c).join(resolve.aliases(r), "canonical_key")
    return n.select("node_id", "node_type", "status", "n_claims", "n_documents", "first_seen", "last_seen", F.md5("title").alias("title_md5"), F.size("aliases").cast("long").alias("n_aliases"), F.md5(F.array_join("aliases", "\n")).alias("aliases_md5"))


def resolved_edges(spark, sf_dir):
    r, _ = _resolved(spark, sf_dir)
    return resolve.edges(r).select("edge_id", "type", "src", "dst", "weight", F.size("segments").cast("long").alias("n_segments"))


def refined_graph(spark, sf_dir):
    """Where accepted reviews, applied until none is left, put every node."""
    with scratch(spark) as keep:
        return keep(families.refine(*_review_inputs(spark, sf_dir), passes=16)[2])


def claims(spark, sf_dir):
    return _claims(spark, sf_dir).select("claim_id", "canonical_key", "claim_no", "candidate_id", "chronology_index", "status")


def node_states(spark, sf_dir):
    return resolve.states(_claims(spark, sf_dir)).select("claim_id", "canonical_key", "claim_no", "state_no")


def worldlines(spark, sf_dir):
    return resolve.worldlines(resolve.states(_claims(spark, sf_dir)))


def nodes_agg(spark, sf_dir):
    return _nodes(spark, sf_dir).select("node_id", "node_type", "status", "n_claims", "n_documents", "n_writing", "n_conversation", "n_chat", "first_seen", "last_seen", F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"))


def edges_agg(spark, sf_dir):
    return _edges(spark, sf_dir).select("edge_id", "type", "src", "dst", "weight", F.size("segments").cast("long").alias("n_segments"), F.md5(F.array_join("segments", ",")).alias("segments_md5"))


def cooccurrence_edges(spark, sf_dir):
    return _edges(spark, sf_dir).where("type = 'co_occurs'").select("src", "dst", "weight")


def related_nodes(spark, sf_dir):
    r = graph.related(_edges(spark, sf_dir))
    return r.groupBy("node").agg(F.count("*").alias("degree"), F.md5(F.array_join(F.array_sort(F.collect_list("nbr")), ",")).alias("neighbours_md5"))


def degree_hubs(spark, sf_dir):
    """The 15 nodes with most neighbours."""
    return graph.degrees(_edges(spark, sf_dir)).orderBy(F.desc("degree"), "node").limit(15)


def connected_components(spark, sf_dir):
    _, n, e = _graph(spark, sf_dir)
    return graph.components(n, e)


def component_shape(spark, sf_dir):
    """How many components there are of each size."""
    c = connected_components(spark, sf_dir)
    return c.groupBy("size").agg(F.count_distinct("root").alias("n_components"))


def shared_neighbors(spark, sf_dir):
    return graph.shared_neighbours(_edges(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 6))


def pair_weights(spark, sf_dir):
    return graph.pair_summaries(_edges(spark, sf_dir)).withColumn("types", F.array_join("types", "+"))


def family_pairs(spark, sf_dir):
    _, n, e = _graph(spark, sf_dir)
    return families.merge_decisions(n, e)


def family_clusters(spark, sf_dir):
    _, n, e = _graph(spark, sf_dir)
    return families.clusters(n, e)


def consolidated_families(spark, sf_dir):
    _, n, e = _graph(spark, sf_dir)
    f = families.families(n, families.clusters(n, e))
    return f.select("family_id", "canonical_key", "node_type", "status", F.size("members").cast("long").alias("n_members"), "n_claims", "first_seen", "last_seen")


def contracted_edges(spark, sf_dir):
    """Edges between groups of nodes with the same first key token."""
    _, n, e = _graph(spark, sf_dir)
    m = n.select("node_id", F.substring_index("canonical_key", "-", 1).alias("family_id"))
    return graph.contract(e, m).select("type", "src", "dst", "weight", F.size("segments").cast("long").alias("n_segments"))


def reciprocal_edges(spark, sf_dir):
    _, n, e = _graph(spark, sf_dir)
    return graph.reciprocal_losers(e, n)


def strongest_neighbor(spark, sf_dir):
    return graph.strongest_edges(_edges(spark, sf_dir))


def near_duplicate_titles(spark, sf_dir):
    w = base.writings(spark, sf_dir).select("document_id", F.array_except(T.title_tokens(F.col("title")), F.array(*map(F.lit, T.TITLE_STOP))).alias("items"))
    return similarity.similar_pairs(w, 0.72, "document_id", "items", max_diff=3).select("a", "b", F.round("score", 3).alias("similarity"))


def summary_pairs(spark, sf_dir):
    n = resolve.nodes(_claims(spark, sf_dir)).select("node_id", "node_type", F.array_distinct(T.tokens(F.col("summary"), T.FAMILY_STOP)).alias("items")).where(F.size("items") >= 5)
    return similarity.similar_pairs(n, 0.72, "node_id", "items", by="node_type").select("a", "b", F.round("score", 6).alias("score"))


def _review_inputs(spark, sf_dir):
    """Nodes with aliases, edges and documents of nodes, each written; what they are made of goes."""
    with scratch(spark) as own:
        c = _cands(spark, sf_dir)
        # reviews ask for weights alone, so no lists of segments are collected
        e = own(cut(resolve.edges(c).drop("segments"), "edges"))
        d = own(cut(_docs(spark, sf_dir, c).select("node_id", "document_id"), "node-documents"))
        n = own(resolve.nodes_of(c))
    return n.withColumn("aliases", F.array("title")), e.withColumn("segments", F.array().cast("array<string>")), d


def _review(spark, sf_dir):
    with scratch(spark) as keep:
        return families.accepts(keep(families.review_candidates(*_review_inputs(spark, sf_dir))))


def review_candidates(spark, sf_dir):
    return _review(spark, sf_dir).select("a", "b", "reason", "semantic", "revision", "blocking", "shared", F.round("title_score", 6).alias("title_score"), F.round("rank_score", 6).alias("rank_score"), "accepted")


def distinct_titles(spark, sf_dir):
    c = _cands(spark, sf_dir)
    n = _nodes(spark, sf_dir, c)
    alias = c.groupBy(F.concat(F.lit("thought:"), F.col("canonical_key")).alias("node_id")).agg(F.collect_set("claim").alias("aliases"))
    return families.distinct_titles(n.join(alias, "node_id").withColumn("title", F.substring_index("title", " ", 1)))


def _assessed(spark, sf_dir):
    c, n, e = _graph(spark, sf_dir)
    return salience.assess(n, _docs(spark, sf_dir, c), graph.degrees(e))


def node_salience(spark, sf_dir):
    a = _assessed(spark, sf_dir)
    return a.select("node_id", "authority", F.size("document_ids").cast("long").alias("n_documents"), "degree", "salience")


def representatives(spark, sf_dir):
    """A quarter of all nodes (900 at least, and never fewer than the authored ones), source-diverse."""
    a = cut(_assessed(spark, sf_dir), "assessed")
    n = a.agg(F.count("*").alias("all"), F.count_if(F.col("authority").isin("authored", "mixed")).alias("authored")).first()
    return salience.representatives(a, max(salience.size_cap(n["all"]), n["authored"]))


def _groups(spark, sf_dir):
    return _nodes(spark, sf_dir).select("node_id", F.explode(F.array_distinct(F.split("canonical_key", "-"))).alias("group_id"))


def constellations(spark, sf_dir):
    """Nodes grouped by key token, rolled up."""
    a = _assessed(spark, sf_dir)
    return salience.group_rollup(_groups(spark, sf_dir), a)


def group_overlaps(spark, sf_dir):
    return salience.overlaps(_groups(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 6))


def label_propagation(spark, sf_dir):
    e = _edges(spark, sf_dir)
    w = e.select("src", "dst", F.round(graph.relation_weight(F.col("type"), F.col("weight")), 6).alias("w"))
    start = graph.related(e).select("node").distinct().select("node", F.substring_index(F.substring("node", 9, 1000), "-", 1).alias("label"))
    return graph.propagate(start, w, 2)


def coverage_repair(spark, sf_dir):
    """Nodes whose key is of odd length take their neighbours' majority group."""
    _, n, e = _graph(spark, sf_dir)
    n = n.withColumn("group_id", F.substring("canonical_key", 1, 1))
    missing, assigned = n.where("length(canonical_key) % 2 = 1"), n.where("length(canonical_key) % 2 = 0")
    return graph.repair_by_vote(assigned, missing, e)


def atlas_drift(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return salience.drift(n, n.where("n_claims > 1")).withColumn("drift", F.round("drift", 6))


def membership_chunks(spark, sf_dir):
    c = salience.chunked(_nodes(spark, sf_dir).select("node_id", "first_seen"), [F.col("first_seen").asc_nulls_last(), F.col("node_id").asc()])
    return c.select("node_id", "place", "chunk_no", "chunk_id")


def top_groups_by_document(spark, sf_dir):
    c = _cands(spark, sf_dir)
    g = _nodes(spark, sf_dir, c).select("node_id", F.substring("canonical_key", 1, 1).alias("group_id"))
    return families.strongest_per_document(g, _docs(spark, sf_dir, c).select("node_id", "document_id"))


def type_counts(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return n.groupBy("node_type").pivot("status", ["active", "tentative"]).agg(F.count(F.lit(1))).na.fill(0)


STOP, FSTOP, TSTOP = base.list_sql(T.MERGE_STOP), base.list_sql(T.FAMILY_STOP), base.list_sql(T.TITLE_STOP)
_tok = lambda x, stop=STOP: base.words_sql(x, 3, stop)
_sum = lambda ks, name: f"sum(CASE WHEN type IN ({', '.join(repr(k) for k in ks)}) THEN weight ELSE 0 END)::BIGINT AS {name}"
base.CTES |= {
    "sent": (("segments",), f"SELECT segment_id, document_id, source_kind, sequence_index, list_slice(list_filter(string_split(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len({_tok('s')}) >= 2), 1, 3) AS ss FROM segments WHERE signal_kind = 'primary' AND source_kind <> 'chat'"),
    "cand0": (("sent",), f"SELECT *, array_to_string(list_slice({_tok('claim')}, 1, 2), '-') AS canonical_key FROM (SELECT segment_id, document_id, source_kind, sequence_index, trim(unnest(ss)) AS claim, generate_subscripts(ss, 1) - 1 AS ord FROM sent)"),
    "cand": (("cand0",), """SELECT segment_id || ':' || ord AS candidate_id, segment_id, document_id, source_kind, ord, claim, canonical_key, CASE WHEN ends_with(claim, '?') THEN 'question' ELSE 'thesis' END AS node_type, CASE WHEN length(claim) % 5 = 0 THEN 'tentative' ELSE 'active' END AS status,
CASE WHEN lead(canonical_key) OVER w <> canonical_key THEN lead(canonical_key) OVER w END AS target_key, claim || coalesce(' ' || lead(claim) OVER w, '') AS summary, CASE WHEN lead(canonical_key) OVER w <> canonical_key THEN ['supports', 'revises', 'supersedes', 'tensions_with', 'context_split', 'semantic_related'][(length(claim) + length(lead(claim) OVER w)) % 6 + 1] END AS relation FROM cand0 WINDOW w AS (PARTITION BY segment_id ORDER BY ord)"""),
    "tl": (("segments",), "SELECT segment_id, time_unix, row_number() OVER (ORDER BY time_unix NULLS LAST, document_id, sequence_index, segment_id) AS chronology_index FROM segments"),
    "claim": (("cand", "tl"), "SELECT *, 'claim:' || canonical_key || ':' || lpad(claim_no::VARCHAR, 4, '0') AS claim_id FROM (SELECT cand.*, time_unix, chronology_index, row_number() OVER (PARTITION BY canonical_key ORDER BY time_unix NULLS LAST, chronology_index, candidate_id) AS claim_no FROM cand JOIN tl USING (segment_id))"),
    "ct": (("claim",), f"SELECT *, {_tok('claim')} AS tok, {_tok('summary')} AS stok FROM claim"),
    "cl": (("ct",), "SELECT *, lag(tok) OVER w AS ptok, lag(stok) OVER w AS pstok, lag(status) OVER w AS pstatus FROM ct WINDOW w AS (PARTITION BY canonical_key ORDER BY claim_no)"),
    "state": (("cl",), f"SELECT *, sum(CASE WHEN pstatus IS NULL OR pstatus <> status OR ({base.jaccard_sql('ptok', 'tok')} < 0.55 AND {base.jaccard_sql('pstok', 'stok')} < 0.6) THEN 1 ELSE 0 END) OVER (PARTITION BY canonical_key ORDER BY claim_no)::BIGINT AS state_no FROM cl"),
    "best": (("claim",), "SELECT canonical_key, arg_min(node_type, (-tn, tf)) AS node_type, arg_min(status, (-sn, sfirst)) AS status FROM (SELECT canonical_key, node_type, status, count(*) OVER (PARTITION BY canonical_key, node_type) AS tn, min(claim_no) OVER (PARTITION BY canonical_key, node_type) AS tf, count(*) OVER (PARTITION BY canonical_key, status) AS sn, min(claim_no) OVER (PARTITION BY canonical_key, status) AS sfirst FROM claim) GROUP BY canonical_key"),
    "node": (("claim", "best"), "SELECT 'thought:' || canonical_key AS node_id, canonical_key, any_value(best.node_type) AS node_type, any_value(best.status) AS status, count(*) AS n_claims, count(DISTINCT document_id) AS n_documents, count(*) FILTER (source_kind = 'writing') AS n_writing, count(*) FILTER (source_kind = 'conversation') AS n_conversation, count(*) FILTER (source_kind = 'chat') AS n_chat, min(time_unix) AS first_seen, max(time_unix) AS last_seen, arg_min(claim, claim_no) AS title, arg_max(claim, claim_no) AS summary FROM claim JOIN best USING (canonical_key) GROUP BY canonical_key"),
    "keys": (("cand",), "SELECT DISTINCT segment_id, canonical_key AS s FROM cand"),
    "rel": (("cand", "keys"), "SELECT segment_id, relation AS type, canonical_key AS s, target_key AS t FROM cand WHERE target_key IN (SELECT canonical_key FROM cand) UNION ALL SELECT a.segment_id, 'co_occurs', a.s, b.s FROM keys a JOIN keys b ON a.segment_id = b.segment_id AND a.s < b.s"),
    "edge": (("rel",), "SELECT type || ':' || src || ':' || dst AS edge_id, * FROM (SELECT type, 'thought:' || CASE WHEN sym THEN least(s, t) ELSE s END AS src, 'thought:' || CASE WHEN sym THEN greatest(s, t) ELSE t END AS dst, count(*) AS weight, list_sort(list(DISTINCT segment_id)) AS segments FROM (SELECT *, type IN ('co_occurs', 'semantic_related', 'tensions_with', 'context_split') AS sym FROM rel) GROUP BY 1, 2, 3)"),
    "nbr": (("edge",), "SELECT DISTINCT src AS node, dst AS nbr FROM edge WHERE src <> dst UNION SELECT DISTINCT dst, src FROM edge WHERE src <> dst"),
    "pos": (("edge",), "SELECT src AS node, dst AS nbr FROM edge WHERE src <> dst AND type IN ('semantic_related', 'supports', 'revises', 'supersedes') UNION SELECT dst, src FROM edge WHERE src <> dst AND type IN ('semantic_related', 'supports', 'revises', 'supersedes')"),
    "sn": (("pos",), "SELECT a, b, shared, shared / (da.n + db.n - 2 * (CASE WHEN d.node IS NULL THEN 0 ELSE 1 END) - shared)::DOUBLE AS jaccard FROM (SELECT x.node AS a, y.node AS b, count(*) AS shared FROM pos x JOIN pos y ON x.nbr = y.nbr AND x.node < y.node GROUP BY 1, 2) p JOIN (SELECT node, count(*) AS n FROM pos GROUP BY node) da ON p.a = da.node JOIN (SELECT node, count(*) AS n FROM pos GROUP BY node) db ON p.b = db.node LEFT JOIN pos d ON d.node = p.a AND d.nbr = p.b"),
    "pw": (("edge",), f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, {_sum(('semantic_related', 'supports'), 'semantic')}, {_sum(('revises', 'supersedes'), 'revision')}, {_sum(('tensions_with', 'context_split'), 'blocking')}, list_sort(list(DISTINCT type)) AS types FROM edge WHERE src <> dst GROUP BY 1, 2"),
    "cp": (("pw", "sn"), "SELECT coalesce(pw.a, sn.a) AS a, coalesce(pw.b, sn.b) AS b, coalesce(semantic, 0) AS semantic, coalesce(revision, 0) AS revision, coalesce(blocking, 0) AS blocking, coalesce(types, []) AS types, coalesce(shared, 0) AS shared, coalesce(jaccard, 0) AS jaccard FROM pw FULL JOIN sn ON pw.a = sn.a AND pw.b = sn.b WHERE types IS NOT NULL OR shared >= 2"),
    "ft": (("node",), f"SELECT node_id, node_type, {_tok('title', FSTOP)} AS tt, {_tok('summary', FSTOP)} AS st, {_tok('canonical_key', FSTOP)} AS kt FROM node"),
    "fp": (("cp", "ft"), f"SELECT cp.*, {base.jaccard_sql('x.tt', 'y.tt')} AS t, {base.jaccard_sql('x.st', 'y.st')} AS s, {base.jaccard_sql('x.kt', 'y.kt')} AS k FROM cp JOIN ft x ON x.node_id = a JOIN ft y ON y.node_id = b WHERE x.node_type = y.node_type AND blocking = 0"),
    "ndoc": (("cand",), "SELECT DISTINCT 'thought:' || canonical_key AS node_id, document_id, source_kind FROM cand"),
    "deg": (("nbr",), "SELECT node, count(*) AS degree FROM nbr GROUP BY node"),
    "sal": (
        ("node", "ndoc", "deg"),
        """SELECT *, round(100 * (authority_w * 0.46 + least(1.0, greatest(n - 1, 0) / 3.0) * 0.18 + least(1.0, log2(1 + n) / log2(5.0)) * 0.14 + log2(1 + degree) / log2(1 + (SELECT greatest(max(degree), 1) FROM deg)) * 0.1 + (CASE node_type WHEN 'thesis' THEN 1.0 WHEN 'question' THEN 0.82 ELSE 0.65 END) * 0.12), 1) AS salience
FROM (SELECT node.node_id, node_type, n, ids, coalesce(degree, 0) AS degree, CASE WHEN w > 0 THEN least(1.0::DOUBLE, 0.78::DOUBLE + (w - 1) * 0.1::DOUBLE + c * 0.04::DOUBLE) WHEN c > 0 THEN least(0.62::DOUBLE, 0.28::DOUBLE + (c - 1) * 0.12::DOUBLE) ELSE 0.0::DOUBLE END AS authority_w, CASE WHEN w > 0 AND c > 0 THEN 'mixed' WHEN w > 0 THEN 'authored' ELSE 'conversation' END AS authority
FROM node JOIN (SELECT node_id, count(*) AS n, count(*) FILTER (source_kind = 'writing') AS w, count(*) FILTER (source_kind = 'conversation') AS c, list_sort(list(DISTINCT document_id)) AS ids FROM ndoc GROUP BY node_id) d ON d.node_id = node.node_id LEFT JOIN deg ON deg.node = node.node_id)""",
    ),
    "grp": (("node",), "SELECT node_id, unnest(list_distinct(string_split(canonical_key, '-'))) AS group_id FROM node"),
}

_LABELS = ", ".join(f"l{k} AS (SELECT node, arg_min(label, (-w, label)) AS label FROM (SELECT node, label, round(sum(w), 6) AS w FROM (SELECT e.a AS node, l{k - 1}.label, e.w FROM ew e JOIN l{k - 1} ON e.b = l{k - 1}.node UNION ALL SELECT node, label, 1.0::DOUBLE FROM l{k - 1}) GROUP BY 1, 2) GROUP BY node)" for k in (1, 2))
_CC = "cc(id, comp) USING KEY (id) AS (SELECT node_id, node_id FROM node UNION (SELECT n.node, min(c.comp) FROM cc c JOIN nbr n ON n.nbr = c.id JOIN recurring.cc p ON p.id = n.node WHERE c.comp < p.comp GROUP BY n.node))"
_cc = lambda q: base.sql("\n" + q, "node", "nbr").replace("WITH ", "WITH RECURSIVE ", 1).replace("\n\n" + q, ",\n" + _CC + "\n" + q, 1)

QUERIES = {
    f.__name__: f
    for f in (
        candidate_claims, identity_pairs, identity_blocks, alias_keys, resolved_nodes, resolved_edges, refined_graph, claims, node_states, worldlines, nodes_agg, edges_agg, cooccurrence_edges, related_nodes, degree_hubs, connected_components, component_shape, shared_neighbors,
        pair_weights, family_pairs, family_clusters, consolidated_families, contracted_edges, reciprocal_edges, strongest_neighbor, near_duplicate_titles, summary_pairs, review_candidates, distinct_titles,
        node_salience, representatives, constellations, group_overlaps, label_propagation, coverage_repair, atlas_drift, membership_chunks, top_groups_by_document, type_counts,
    )
}

_RANK = "CASE type WHEN 'revises' THEN 7 WHEN 'supersedes' THEN 6 WHEN 'tensions_with' THEN 5 WHEN 'context_split' THEN 4 WHEN 'supports' THEN 3 WHEN 'semantic_related' THEN 2 ELSE 1 END"
SQL = {
    "candidate_claims": base.sql("SELECT candidate_id, segment_id, document_id, canonical_key, node_type, status, target_key, relation, md5(claim) AS claim_md5 FROM cand", "cand"),
    "identity_pairs": base.sql(
        f"""SELECT x.key AS a, y.key AS b FROM (SELECT canonical_key AS key, node_type, {_tok('title')} AS tt, {_tok('summary')} AS st, {_tok('canonical_key')} AS kt, array_to_string(list_sort(list_slice(CASE WHEN len({_tok('title')}) > 0 THEN {_tok('title')} ELSE {_tok('canonical_key')} END, 1, 4)), '-') AS sig FROM node) x
JOIN (SELECT canonical_key AS key, node_type, {_tok('title')} AS tt, {_tok('summary')} AS st, {_tok('canonical_key')} AS kt, array_to_string(list_sort(list_slice(CASE WHEN len({_tok('title')}) > 0 THEN {_tok('title')} ELSE {_tok('canonical_key')} END, 1, 4)), '-') AS sig FROM node) y
ON x.node_type = y.node_type AND x.sig = y.sig AND x.key < y.key WHERE x.sig <> '' AND ({base.jaccard_sql('x.tt', 'y.tt')} >= 0.8 OR {base.jaccard_sql('x.kt', 'y.kt')} >= 0.8 OR (({base.jaccard_sql('x.tt', 'y.tt')} >= 0.5 OR {base.jaccard_sql('x.kt', 'y.kt')} >= 0.5) AND ({base.jaccard_sql('x.st', 'y.st')} >= 0.35 OR {base.jaccard_sql('x.tt', 'y.tt')} >= 0.35)))""", "node"),
    "claims": base.sql("SELECT claim_id, canonical_key, claim_no, candidate_id, chronology_index, status FROM claim", "claim"),
    "node_states": base.sql("SELECT claim_id, canonical_key, claim_no, state_no FROM state", "state"),
    "worldlines": base.sql("""SELECT canonical_key, state_no, 'state:' || canonical_key || ':' || lpad(state_no::VARCHAR, 4, '0') AS state_id, valid_from, lead(valid_from) OVER w AS valid_until, n_claims, status, CASE WHEN state_no = 1 THEN 'introduced' ELSE 'revised' END AS transition, lead(state_no) OVER w IS NOT NULL AS invalidated
FROM (SELECT canonical_key, state_no, min(time_unix) AS valid_from, count(*) AS n_claims, arg_min(status, claim_no) AS status FROM state GROUP BY 1, 2) WINDOW w AS (PARTITION BY canonical_key ORDER BY state_no)""", "state"),
    "nodes_agg": base.sql("SELECT node_id, node_type, status, n_claims, n_documents, n_writing, n_conversation, n_chat, first_seen, last_seen, md5(title) AS title_md5, md5(summary) AS summary_md5 FROM node", "node"),
    "edges_agg": base.sql("SELECT edge_id, type, src, dst, weight, len(segments)::BIGINT AS n_segments, md5(array_to_string(segments, ',')) AS segments_md5 FROM edge", "edge"),
    "cooccurrence_edges": base.sql("SELECT src, dst, weight FROM edge WHERE type = 'co_occurs'", "edge"),
    "related_nodes": base.sql("SELECT node, count(*) AS degree, md5(string_agg(nbr, ',' ORDER BY nbr)) AS neighbours_md5 FROM nbr GROUP BY node", "nbr"),
    "degree_hubs": base.sql("SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 15", "deg"),
    "shared_neighbors": base.sql("SELECT a, b, shared, round(jaccard, 6) AS jaccard FROM sn WHERE shared >= 2", "sn"),
    "pair_weights": base.sql("SELECT a, b, semantic, revision, blocking, array_to_string(types, '+') AS types FROM pw", "pw"),
    "family_pairs": base.sql("""SELECT a, b, reason FROM (SELECT a, b, CASE WHEN list_has_any(types, ['revises', 'supersedes']) AND (list_contains(types, 'supports') OR greatest(t, s, k) >= 0.18 OR (shared >= 3 AND jaccard >= 0.25)) THEN 'revision_family'
WHEN list_has_any(types, ['semantic_related', 'supports']) AND shared >= 2 AND (t >= 0.4 OR s >= 0.45) THEN 'relation_assisted_family' WHEN shared >= 2 AND (t >= 0.72 OR k >= 0.72 OR (t >= 0.4 AND s >= 0.6)) THEN 'lexical_family' END AS reason FROM fp) WHERE reason IS NOT NULL""", "fp"),
    "contracted_edges": base.sql("""SELECT type, src, dst, sum(weight)::BIGINT AS weight, len(list_distinct(flatten(list(segments))))::BIGINT AS n_segments FROM (SELECT type, weight, segments, CASE WHEN sym THEN least(f, g) ELSE f END AS src, CASE WHEN sym THEN greatest(f, g) ELSE g END AS dst
FROM (SELECT *, split_part(substr(src, 9), '-', 1) AS f, split_part(substr(dst, 9), '-', 1) AS g, type IN ('co_occurs', 'semantic_related', 'tensions_with', 'context_split') AS sym FROM edge) WHERE f <> g) GROUP BY type, src, dst""", "edge"),
    "reciprocal_edges": base.sql("""SELECT edge_id FROM (SELECT e.edge_id, (coalesce(n.last_seen, -1), coalesce(n.first_seen, -1), e.weight, e.edge_id) < (coalesce(m.last_seen, -1), coalesce(m.first_seen, -1), o.weight, o.edge_id) AS lost
FROM edge e JOIN edge o ON e.src = o.dst AND e.dst = o.src AND e.type = o.type JOIN node n ON n.node_id = e.src JOIN node m ON m.node_id = o.src WHERE e.type IN ('revises', 'supersedes')) WHERE lost""", "edge", "node"),
    "strongest_neighbor": base.sql(f"""SELECT node, nbr, way, type, weight FROM (SELECT *, row_number() OVER (PARTITION BY node, nbr ORDER BY {_RANK} DESC, weight DESC, edge_id, way) AS r FROM (SELECT src AS node, dst AS nbr, 'out' AS way, type, weight, edge_id FROM edge WHERE src <> dst UNION ALL SELECT dst, src, 'in', type, weight, edge_id FROM edge WHERE src <> dst)) WHERE r = 1""", "edge"),
    "near_duplicate_titles": base.sql(f"""SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, round({base.jaccard_sql('x.s', 'y.s')}, 3) AS similarity FROM (SELECT 'writing:' || doc_id AS id, list_filter(list_distinct(string_split({base.slug_sql("coalesce(ls[1], '')")}, '-')), lambda t: length(t) >= 2 AND NOT list_contains({TSTOP}, t)) AS s FROM w_lines) x
JOIN (SELECT 'writing:' || doc_id AS id, list_filter(list_distinct(string_split({base.slug_sql("coalesce(ls[1], '')")}, '-')), lambda t: length(t) >= 2 AND NOT list_contains({TSTOP}, t)) AS s FROM w_lines) y ON x.id < y.id AND len(x.s) > 0 AND len(y.s) > 0 AND abs(len(x.s) - len(y.s)) <= 3 AND list_has_any(x.s, y.s) WHERE {base.jaccard_sql('x.s', 'y.s')} >= 0.72""", "w_lines"),
    "summary_pairs": base.sql(f"""SELECT a, b, round(inter / (na + nb - inter)::DOUBLE, 6) AS score FROM (SELECT x.node_id AS a, y.node_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS inter FROM st x JOIN st y ON x.t = y.t AND x.node_type = y.node_type AND x.node_id < y.node_id GROUP BY 1, 2) WHERE inter / (na + nb - inter)::DOUBLE >= 0.72""", "node").replace("\nSELECT a, b, round", f", st AS (SELECT node_id, node_type, len(s) AS n, unnest(s) AS t FROM (SELECT node_id, node_type, list_distinct({_tok('summary', FSTOP)}) AS s FROM node) WHERE len(s) >= 5)\nSELECT a, b, round", 1),
    "node_salience": base.sql("SELECT node_id, authority, n AS n_documents, degree, salience FROM sal", "sal"),
    "group_overlaps": base.sql("SELECT a, b, shared, round(shared / (na.n + nb.n - shared)::DOUBLE, 6) AS jaccard FROM (SELECT x.group_id AS a, y.group_id AS b, count(*) AS shared FROM grp x JOIN grp y ON x.node_id = y.node_id AND x.group_id < y.group_id GROUP BY 1, 2) JOIN (SELECT group_id, count(*) AS n FROM grp GROUP BY 1) na ON na.group_id = a JOIN (SELECT group_id, count(*) AS n FROM grp GROUP BY 1) nb ON nb.group_id = b WHERE shared / (na.n + nb.n - shared)::DOUBLE > 0.35", "grp"),
    "constellations": base.sql("""SELECT group_id, 'macro:' || substr(sha256(string_agg(node_id, chr(10) ORDER BY node_id)), 1, 10) AS stable_id, count(*) AS n_members, round(sum(round(salience * 10)::BIGINT)::DOUBLE / (10 * count(*)), 4) AS mean_salience, CASE WHEN bool_or(authority = 'mixed') OR (bool_or(authority = 'authored') AND bool_or(authority = 'conversation')) THEN 'mixed' WHEN bool_or(authority = 'authored') THEN 'authored' ELSE 'conversation' END AS authority, len(list_distinct(flatten(list(ids))))::BIGINT AS n_documents FROM grp JOIN sal USING (node_id) GROUP BY group_id""", "grp", "sal"),
    "coverage_repair": base.sql("""SELECT node_id, group_id, votes FROM (SELECT node AS node_id, group_id, n AS votes, row_number() OVER w AS r, coalesce(lead(n) OVER w, 0) AS nx FROM (SELECT nbr.node, substr(x.canonical_key, 1, 1) AS group_id, count(*) AS n FROM nbr JOIN node m ON m.node_id = nbr.node AND length(m.canonical_key) % 2 = 1 JOIN node x ON x.node_id = nbr.nbr AND length(x.canonical_key) % 2 = 0 GROUP BY 1, 2) WINDOW w AS (PARTITION BY node ORDER BY n DESC, group_id)) WHERE r = 1 AND votes >= 2 AND votes > nx""", "nbr", "node"),
    "atlas_drift": base.sql("SELECT count(*) AS n_current, count(*) FILTER (n_claims > 1) AS n_previous, count(*) FILTER (n_claims > 1) AS n_shared, round(1 - count(*) FILTER (n_claims > 1) / greatest(1, count(*))::DOUBLE, 6) AS drift FROM node", "node"),
    "membership_chunks": base.sql("SELECT node_id, p AS place, (p - 1) // 48 AS chunk_no, 'batch-' || lpad(((p - 1) // 48 + 1)::VARCHAR, 4, '0') AS chunk_id FROM (SELECT node_id, row_number() OVER (ORDER BY first_seen NULLS LAST, node_id) AS p FROM node)", "node"),
    "top_groups_by_document": base.sql("SELECT document_id, group_id, n, rank::INT AS rank FROM (SELECT document_id, group_id, n, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, group_id) AS rank FROM (SELECT document_id, substr(node_id, 9, 1) AS group_id, count(DISTINCT node_id) AS n FROM ndoc GROUP BY 1, 2)) WHERE rank <= 5", "ndoc"),
    "connected_components": _cc("SELECT id AS node_id, comp AS root, count(*) OVER (PARTITION BY comp) AS size FROM cc"),
    "component_shape": _cc("SELECT size, count(*) AS n_components FROM (SELECT comp, count(*) AS size FROM cc GROUP BY comp) GROUP BY size"),
    "label_propagation": base.sql("SELECT node, label FROM l2", "edge", "nbr").replace("\nSELECT node, label FROM l2", ", ew AS (SELECT src AS a, dst AS b, round(greatest(0.25::DOUBLE, log2(1 + weight) * CASE WHEN type IN ('revises', 'supersedes') THEN 1.35::DOUBLE WHEN type = 'co_occurs' THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END), 6) AS w FROM edge UNION ALL SELECT dst, src, round(greatest(0.25::DOUBLE, log2(1 + weight) * CASE WHEN type IN ('revises', 'supersedes') THEN 1.35::DOUBLE WHEN type = 'co_occurs' THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END), 6) FROM edge), l0 AS (SELECT DISTINCT node, split_part(substr(node, 9), '-', 1) AS label FROM nbr), " + _LABELS + "\nSELECT node, label FROM l2", 1),
    "type_counts": base.sql("SELECT node_type, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'tentative') AS tentative FROM node GROUP BY node_type", "node"),
}
