"""Queries on retrieval, frames, incremental recomputation, audits, and event streams in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import audit, corpus, frames, incremental, resolve, retrieval
from ..streaming import events as S
from . import base, graph, ingest
from .storage import cut


def _chunks(spark, sf_dir):
    return base.writings(spark, sf_dir).select(F.col("document_id").alias("chunk_id"), "title", F.col("body").alias("text"))


def _questions(spark, sf_dir):
    return base.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def retrieval_chunks(spark, sf_dir):
    """Documents' lines that start with a pipe table's word as sections: a heading stands before every third line."""
    d = base.table(spark, sf_dir, "documents")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("## "), x)).otherwise(x)), "\n")
    c = retrieval.chunks(d.select(F.col("doc_id").cast("string").alias("name"), body.alias("body")))
    return c.select("name", "chunk_no", F.md5("title").alias("title_md5"), F.md5("text").alias("text_md5"))


def term_index(spark, sf_dir):
    tf, df = retrieval.index(_chunks(spark, sf_dir))
    return tf.groupBy("term").agg(F.sum("tf").alias("total"), F.max("tf").alias("most")).join(df, "term")


def tfidf_topk(spark, sf_dir):
    s = retrieval.scores(_questions(spark, sf_dir), _chunks(spark, sf_dir))
    return retrieval.top(s).select("question_id", "chunk_id", "rank", "score")


def retrieval_mrr(spark, sf_dir):
    """Right chunks are the documents that hold the question's first line."""
    q, c = _questions(spark, sf_dir), _chunks(spark, sf_dir)
    ranked = retrieval.top(retrieval.scores(q, c))
    line = F.element_at(F.split("question", "\n"), 1)
    expected = ranked.join(q, "question_id").join(c, "chunk_id").where(F.contains("text", line)).select("question_id", "chunk_id")
    return retrieval.audit(ranked, expected, q)


def site_search(spark, sf_dir):
    p = base.writings(spark, sf_dir).select(F.col("document_id").alias("page_id"), "title", "body")
    return retrieval.site_search(p, "the license")


def node_evidence(spark, sf_dir):
    c = graph._cands(spark, sf_dir)
    refs = c.select(F.concat(F.lit("thought:"), F.col("canonical_key")).alias("node_id"), "segment_id")
    return retrieval.evidence(refs, base.segments(spark, sf_dir).select("segment_id", "document_id", "sequence_index"))


def source_index(spark, sf_dir):
    c = graph._cands(spark, sf_dir).select("segment_id", "document_id", "canonical_key")
    return c.groupBy("segment_id", "document_id").agg(F.array_join(F.array_sort(F.collect_set("canonical_key")), "|").alias("nodes"))


def summary_score(spark, sf_dir):
    """Titles as display sentences: a capital, a final mark, and points for length and form."""
    w = base.writings(spark, sf_dir)
    s = T.capitalize(T.squeeze(F.col("title")))
    s = F.when(s.rlike("[.?!]$"), s).otherwise(F.concat(s, F.lit(".")))
    score = F.when(F.length(s) < 20, -10).when(F.length(s) <= 160, 20).otherwise(5) + F.when(s.contains("?"), 3).otherwise(0) - 2 * F.regexp_count(s, F.lit("[|#*$%&]"))
    return w.select("document_id", F.md5(s).alias("sentence_md5"), score.cast("long").alias("score"))


def _listed(spark, sf_dir):
    """Frames of a document by what its paragraphs start with: the first letter's class; every seventh paragraph is in none, every fifth in two."""
    s = base.segments(spark, sf_dir).where("source_kind = 'writing'").select("document_id", F.col("sequence_index").alias("pos"), (F.length("text") % 3).cast("int").alias("frame_idx"), "text")
    s = cut(s, "listed")  # used several times; segments are split from texts once
    own = s.where("pos % 7 <> 0").select("document_id", "frame_idx", "pos")
    twice = s.where("pos % 5 = 0 AND pos % 7 <> 0").select("document_id", ((F.col("frame_idx") + 1) % 3).cast("int").alias("frame_idx"), "pos")
    return s, own.unionByName(twice)


def frame_assignment(spark, sf_dir):
    s, listed = _listed(spark, sf_dir)
    return frames.materialize(listed, s.select("document_id", "pos"))


def frame_scopes(spark, sf_dir):
    s, listed = _listed(spark, sf_dir)
    return frames.scopes(frames.materialize(listed, s.select("document_id", "pos")))


def longest_runs(spark, sf_dir):
    return frames.longest_runs(_listed(spark, sf_dir)[1], ["document_id", "frame_idx"])


def frame_contiguity(spark, sf_dir):
    return frames.contiguous(_listed(spark, sf_dir)[1], ["document_id", "frame_idx"])


def suppressed_frames(spark, sf_dir):
    s, listed = _listed(spark, sf_dir)
    sizes = listed.groupBy("document_id", "frame_idx").agg(F.count_distinct("pos").alias("n"))
    subs = listed.withColumn("sub_idx", (F.col("pos") % 4).cast("int"))
    return frames.suppressed(subs, sizes)


def anchor_tokens(spark, sf_dir):
    w = base.writings(spark, sf_dir).select("document_id", F.col("body").alias("text"))
    return frames.anchor_tokens(w, ["document_id"]).select("document_id", F.array_join("anchors", " ").alias("anchors"))


def _frames(spark, sf_dir):
    """Frames, their nodes and these nodes' support; of the writings' candidates only what frames need is written."""
    c = resolve.candidates(corpus.writing_segments(base.writings(spark, sf_dir), r"\n"))
    fid = F.concat_ws(":", F.lit("frame"), "document_id", (F.col("sequence_index") % 3).cast("string"))
    m = cut(c.select(fid.alias("frame_id"), "document_id", F.col("canonical_key").alias("node_id"), F.when(F.col("node_type") == "question", "question").when(F.col("ord") == 0, "main_claim").otherwise("subclaim").alias("role"), "claim", "sequence_index", "ord"), "frame-claims")
    labels = m.groupBy("frame_id", "document_id").agg(F.min_by("claim", F.struct("sequence_index", "ord")).alias("label"))
    anchors = frames.anchor_tokens(m.select("frame_id", F.col("claim").alias("text")), ["frame_id"])
    support = frames.anchor_nodes(m.groupBy("frame_id", "node_id", "role").agg(F.count("*").alias("n")))
    members = m.select("frame_id", "node_id").distinct().join(support.select("frame_id", "node_id", F.lit(True).alias("anchor")), ["frame_id", "node_id"], "left").na.fill({"anchor": False})
    return labels.join(anchors, "frame_id", "left"), members, support


def frame_anchors(spark, sf_dir):
    return _frames(spark, sf_dir)[2]


def frame_pairs(spark, sf_dir):
    f, m, _ = _frames(spark, sf_dir)
    return frames.frame_pairs(f, m)


def frame_families(spark, sf_dir):
    f, m, _ = _frames(spark, sf_dir)
    return frames.aligned_families(f, m)


def _snapshots(spark, sf_dir):
    """The segments now, and before: every seventh missing, every eleventh with other text."""
    s = base.segments(spark, sf_dir).where("signal_kind = 'primary' AND source_kind = 'writing'")
    old = s.where("length(segment_id) + sequence_index * 3 <> 0 AND sequence_index % 7 <> 0").withColumn("text", F.when(F.col("sequence_index") % 11 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    return incremental.segment_index(old), incremental.segment_index(s)


def segment_diff(spark, sf_dir):
    return incremental.diff(*_snapshots(spark, sf_dir))


def segment_hashes(spark, sf_dir):
    return _snapshots(spark, sf_dir)[1]


def pending_items(spark, sf_dir):
    old, now = _snapshots(spark, sf_dir)
    return incremental.pending(now, old).select("segment_id", "cache_key")


def cache_resolution(spark, sf_dir):
    """What the mixed policy reuses: the previously active entry while the text is the same, else the exact key's."""
    old, now = _snapshots(spark, sf_dir)
    items = now.join(old.select("segment_id", F.col("cache_key").alias("active_key")), "segment_id", "left")
    return incremental.resolve_cache(items, old.select("cache_key", "text_hash", F.lit("v1").alias("contract")).dropDuplicates(["cache_key"]))


def cache_upsert(spark, sf_dir):
    old, now = _snapshots(spark, sf_dir)
    return incremental.upsert(old.select("segment_id", "text_hash"), now.where("substring(text_hash, 1, 1) < '8'").select("segment_id", "text_hash"), "segment_id")


def document_hashes(spark, sf_dir):
    s = base.segments(spark, sf_dir).where("source_kind <> 'chat'")
    return incremental.ordered_hash(s, "document_id", "segment_id", "text")


def affected_scope(spark, sf_dir):
    """Nodes as families; before, those with one claim had another title and every key of a length divisible by 7 was missing."""
    _, n, e = graph._graph(spark, sf_dir)
    now = n.select(F.col("node_id").alias("family_id"), F.sha2("canonical_key", 256).alias("representative_hash"), F.sha2("summary", 256).alias("synthesis_hash"))
    old = n.where("length(canonical_key) % 7 <> 0").select(F.col("node_id").alias("family_id"), F.sha2("canonical_key", 256).alias("representative_hash"), F.sha2(F.when(F.length("canonical_key") % 5 == 0, F.concat("summary", F.lit("x"))).otherwise(F.col("summary")), 256).alias("synthesis_hash"))
    return incremental.affected(old, now, e)


def scope_decision(spark, sf_dir):
    return incremental.scope_decision(affected_scope(spark, sf_dir)).withColumn("share", F.round("share", 6))


def edge_dependencies(spark, sf_dir):
    d = incremental.dependencies(graph._edges(spark, sf_dir))
    return d.select("family_id", F.size("incoming").cast("long").alias("n_in"), F.size("outgoing").cast("long").alias("n_out"), F.size("neighbours").cast("long").alias("n_neighbours"))


def coverage_by_kind(spark, sf_dir):
    c = audit.coverage(base.segments(spark, sf_dir), graph._cands(spark, sf_dir))
    return c.withColumn("share", F.round("share", 6))


def weak_provenance(spark, sf_dir):
    c = graph._cands(spark, sf_dir).select(F.col("canonical_key").alias("node_id"), "segment_id")
    members = c.select("node_id", F.substring_index("node_id", "-", 1).alias("family_id")).distinct()
    return audit.weak_merges(members, c)


def one_off_nodes(spark, sf_dir):
    return audit.one_offs(graph._nodes(spark, sf_dir))


def state_proliferation(spark, sf_dir):
    return audit.state_growth(resolve.states(graph._claims(spark, sf_dir)))


def density_audit(spark, sf_dir):
    s = base.segments(spark, sf_dir).where("signal_kind = 'primary' AND source_kind <> 'chat'")
    n = graph._cands(spark, sf_dir).groupBy("segment_id").agg(F.count("*").alias("n_candidates"))
    rows = s.join(n, "segment_id", "left").na.fill(0, ["n_candidates"]).withColumn("n_chars", F.length("text"))
    return audit.density(rows, ["document_id"]).withColumn("mean", F.round("mean", 6))


def turn_audit(spark, sf_dir):
    """The 20 longest turns that the sanitiser keeps, whole or trimmed, by what is kept."""
    return ingest.turn_sanitize(spark, sf_dir).where("action <> 'drop'").orderBy(F.desc("n_clean"), "id").limit(20).select("id", "action", "n_clean")


def frame_audit(spark, sf_dir):
    s, listed = _listed(spark, sf_dir)
    key = F.concat_ws(":", "document_id", F.col("frame_idx").cast("string"))
    c = frames.contiguous(listed, ["document_id", "frame_idx"])
    double = listed.groupBy("document_id", "pos").agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws(":", "document_id", F.col("pos").cast("string")).alias("id"))
    free = s.select("document_id", "pos").join(listed.select("document_id", "pos"), ["document_id", "pos"], "left_anti").select(F.concat_ws(":", "document_id", F.col("pos").cast("string")).alias("id"))
    found = audit.issues(frame_not_contiguous=c.where("NOT contiguous").select(key.alias("id")), single_segment_frame=c.where("n = 1").select(key.alias("id")), overlapping_segment=double, unassigned_segment=free)
    return audit.summary(found)


def duplicate_texts(spark, sf_dir):
    return audit.duplicates(base.table(spark, sf_dir, "documents").withColumn("h", F.md5("text")), "h").withColumnRenamed("id", "text_md5")


def session_windows(spark, sf_dir):
    s = S.sessions(base.table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,4)")))
    return s.select("user_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended_us"), "n_events", F.col("total").cast("double").alias("total"))


def tumbling_counts(spark, sf_dir):
    t = S.tumbling(base.table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,4)")), width="1 day")
    return t.select(F.date_format("started", "yyyy-MM-dd").alias("day"), "event_type", "n_events", F.col("total").cast("double").alias("total"))


def deduplicated_events(spark, sf_dir):
    """Every event once, of a stream that brings each seventh twice."""
    e = base.table(spark, sf_dir, "events").select("event_id", "ts")
    return S.deduplicated(e.unionByName(e.where("event_id % 7 = 0"))).select("event_id")


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_chunks, term_index, tfidf_topk, retrieval_mrr, site_search, node_evidence, source_index, summary_score, frame_assignment, frame_scopes, longest_runs, frame_contiguity, suppressed_frames, anchor_tokens,
        frame_anchors, frame_pairs, frame_families, segment_diff, segment_hashes, pending_items, cache_resolution, cache_upsert, document_hashes, affected_scope, scope_decision, edge_dependencies, coverage_by_kind,
        weak_provenance, one_off_nodes, state_proliferation, density_audit, turn_audit, frame_audit, duplicate_texts, session_windows, tumbling_counts, deduplicated_events,
    )
}

SSTOP, ASTOP = base.list_sql(T.SEARCH_STOP), base.list_sql(T.ALIGN_STOP)
_stok = lambda x: base.words_sql(x, 3, SSTOP)
_plain = lambda x: f"strip_accents(lower({x}))"
base.CTES |= {
    "chunk": (("w_lines",), "SELECT 'writing:' || d.doc_id AS chunk_id, coalesce(ls[1], '') AS title, text FROM documents d JOIN w_lines w ON d.doc_id = w.doc_id"),
    "tf": (("chunk",), f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_stok(chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || text')}) AS term FROM chunk) GROUP BY 1, 2"),
    "df": (("tf",), "SELECT term, count(*) AS df FROM tf GROUP BY term"),
    "qterm": ((), f"SELECT item_id AS question_id, unnest(list_distinct({_stok('text')})) AS term FROM benchmark"),
    "score": (("qterm", "tf", "df", "chunk"), f"SELECT question_id, chunk_id, round(s + CASE WHEN contains({_plain('title')}, {_plain('b.text')}) OR contains({_plain('b.text')}, {_plain('title')}) THEN 18.0 ELSE 0.0 END, 6) AS score FROM (SELECT question_id, chunk_id, sum((1 + ln(least(tf, 8))) * (ln(((SELECT count(*) FROM chunk) + 1)::DOUBLE / (df + 1)) + 1)) AS s FROM qterm JOIN df USING (term) JOIN tf USING (term) GROUP BY 1, 2) JOIN chunk USING (chunk_id) JOIN benchmark b ON b.item_id = question_id"),
    "ranked": (("score",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM score) WHERE rank <= 8"),
    "lp": (("segments",), "SELECT document_id, sequence_index AS pos, length(text) % 3 AS f FROM segments WHERE source_kind = 'writing'"),
    "listed": (("lp",), "SELECT document_id, f::INT AS frame_idx, pos FROM lp WHERE pos % 7 <> 0 UNION ALL SELECT document_id, ((f + 1) % 3)::INT, pos FROM lp WHERE pos % 5 = 0 AND pos % 7 <> 0"),
    "asg": (("listed",), "SELECT document_id, pos, min(frame_idx) AS frame_idx FROM listed GROUP BY 1, 2"),
    "rng": (("asg",), "SELECT document_id, frame_idx, min(pos) AS lo, max(pos) AS hi FROM asg GROUP BY 1, 2"),
    "placed": (("asg", "rng", "lp"), "SELECT document_id, pos, frame_idx, 'listed' AS how FROM asg UNION ALL SELECT document_id, pos, arg_min(frame_idx, (CASE WHEN pos < lo THEN lo - pos WHEN pos > hi THEN pos - hi ELSE 0 END, frame_idx)), 'nearest' FROM (SELECT lp.* FROM lp ANTI JOIN asg USING (document_id, pos)) JOIN rng USING (document_id) GROUP BY document_id, pos UNION ALL SELECT document_id, pos, 0, 'fallback' FROM lp WHERE document_id NOT IN (SELECT document_id FROM asg)"),
    "fm": (("cand",), "SELECT 'frame:' || document_id || ':' || (split_part(segment_id, ':', 4)::INT % 3) AS frame_id, document_id, canonical_key AS node_id, CASE WHEN node_type = 'question' THEN 2.0 WHEN ord = 0 THEN 3.0 ELSE 1.0 END AS w, claim, split_part(segment_id, ':', 4)::INT AS seq, ord FROM cand WHERE source_kind = 'writing'"),
    "fsup": (("fm",), "SELECT frame_id, node_id, support FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY support DESC, node_id) AS r FROM (SELECT frame_id, node_id, sum(w)::DOUBLE AS support FROM fm GROUP BY 1, 2)) WHERE r <= 2"),
    "ftok": (("fm",), f"SELECT frame_id, t, count(*) AS n FROM (SELECT frame_id, unnest({base.words_sql('claim', 3, ASTOP)}) AS t FROM fm) GROUP BY 1, 2"),
    "fanc": (("ftok",), "SELECT frame_id, list(t ORDER BY r) AS anchors FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, t) AS r FROM ftok) WHERE r <= 5 GROUP BY frame_id"),
    "flab": (("fm", "fanc"), f"SELECT frame_id, document_id, {base.words_sql('label', 3, ASTOP)} AS lt, anchors, n FROM (SELECT frame_id, document_id, arg_min(claim, (seq, ord)) AS label, count(DISTINCT node_id) AS n FROM fm GROUP BY 1, 2) LEFT JOIN fanc USING (frame_id)"),
    "fmem": (("fm", "fsup"), "SELECT DISTINCT fm.frame_id, fm.node_id, fsup.node_id IS NOT NULL AS anchor FROM fm LEFT JOIN fsup ON fm.frame_id = fsup.frame_id AND fm.node_id = fsup.node_id"),
    "fpair": (("fmem", "flab"), f"""SELECT a, b, shared FROM (SELECT x.frame_id AS a, y.frame_id AS b, count(*) AS shared, count(*) FILTER (x.anchor AND y.anchor) AS anc FROM fmem x JOIN fmem y ON x.node_id = y.node_id AND x.frame_id < y.frame_id GROUP BY 1, 2) p JOIN flab f ON f.frame_id = a JOIN flab g ON g.frame_id = b
WHERE f.document_id <> g.document_id AND shared / least(f.n, g.n)::DOUBLE >= 0.5 AND ((anc >= 1 AND {base.jaccard_sql('f.anchors', 'g.anchors')} >= 0.14) OR (shared >= 2 AND {base.jaccard_sql('f.lt', 'g.lt')} >= 0.16))"""),
    "snow": (("segments",), "SELECT segment_id, document_id, sequence_index, text FROM segments WHERE source_kind = 'writing'"),
    "sold": (("snow",), "SELECT segment_id, document_id, sequence_index, CASE WHEN sequence_index % 11 = 0 THEN text || ' old' ELSE text END AS text FROM snow WHERE sequence_index % 7 <> 0"),
    "inow": (("snow",), "SELECT *, sha256('v1|' || text_hash || '|' || context_hash) AS cache_key FROM (SELECT segment_id, document_id, sha256(text) AS text_hash, sha256(coalesce(lag(text) OVER w, '') || chr(31) || coalesce(lead(text) OVER w, '')) AS context_hash FROM snow WINDOW w AS (PARTITION BY document_id ORDER BY sequence_index))"),
    "iold": (("sold",), "SELECT *, sha256('v1|' || text_hash || '|' || context_hash) AS cache_key FROM (SELECT segment_id, document_id, sha256(text) AS text_hash, sha256(coalesce(lag(text) OVER w, '') || chr(31) || coalesce(lead(text) OVER w, '')) AS context_hash FROM sold WINDOW w AS (PARTITION BY document_id ORDER BY sequence_index))"),
    "aff": (("node", "edge"), "SELECT node_id AS family_id, st AS state, st IN ('added', 'changed') OR node_id IN (SELECT dst FROM edge JOIN node ON src = node_id AND src <> dst AND (length(canonical_key) % 7 = 0 OR length(canonical_key) % 5 = 0)) OR node_id IN (SELECT src FROM edge JOIN node ON dst = node_id AND src <> dst AND (length(canonical_key) % 7 = 0 OR length(canonical_key) % 5 = 0)) AS in_review FROM (SELECT node_id, CASE WHEN length(canonical_key) % 7 = 0 THEN 'added' WHEN length(canonical_key) % 5 = 0 THEN 'changed' ELSE 'reused' END AS st FROM node)"),
}
_sent = "upper(substr({t}, 1, 1)) || substr({t}, 2)".format(t="trim(regexp_replace(coalesce(ls[1], ''), '\\s+', ' ', 'g'))")
SQL = {
    "retrieval_chunks": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), c AS (SELECT doc_id, sum((i % 3 = 1)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k, i, CASE WHEN i % 3 = 1 THEN '## ' || x ELSE x END AS x FROM l),
t AS (SELECT doc_id, k, string_agg(x, chr(10) ORDER BY i) AS text, arg_min(x, i) AS head FROM c GROUP BY doc_id, k)
SELECT doc_id::VARCHAR AS name, k::BIGINT AS chunk_no, md5(CASE WHEN k = 0 THEN doc_id::VARCHAR ELSE regexp_replace(head, '^#+\\s*', '') END) AS title_md5, md5(text || CASE WHEN k < max(k) OVER (PARTITION BY doc_id) THEN chr(10) ELSE '' END) AS text_md5 FROM t""",
    "term_index": base.sql("SELECT term, sum(tf)::BIGINT AS total, max(tf) AS most, any_value(df) AS df FROM tf JOIN df USING (term) GROUP BY term", "tf", "df"),
    "tfidf_topk": base.sql("SELECT question_id, chunk_id, rank, score FROM ranked", "ranked"),
    "retrieval_mrr": base.sql("""SELECT count(*) AS n_questions, coalesce(round(avg((coalesce(rank, 99) <= 5)::INT), 6), 1.0) AS pass_rate, coalesce(round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6), 1.0) AS mrr FROM benchmark LEFT JOIN (SELECT question_id, min(rank) AS rank FROM ranked JOIN chunk USING (chunk_id) JOIN benchmark b ON b.item_id = question_id WHERE contains(chunk.text, split_part(b.text, chr(10), 1)) GROUP BY 1) ON item_id = question_id""", "ranked"),
    "site_search": base.sql("SELECT page_id, score FROM (SELECT chunk_id AS page_id, CASE WHEN lower(title) = 'the license' THEN 100 WHEN starts_with(lower(title), 'the license') THEN 70 ELSE 15 * contains(h, 'the')::INT + 15 * contains(h, 'license')::INT + 25 * contains(h, 'the license')::INT END AS score FROM (SELECT *, lower(title || ' ' || text) AS h FROM chunk)) WHERE score > 0 ORDER BY score DESC, page_id LIMIT 8", "chunk"),
    "node_evidence": base.sql("SELECT node_id, segment_id, document_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY nth, document_id, seq, segment_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY node_id, document_id ORDER BY seq, segment_id) AS nth FROM (SELECT DISTINCT 'thought:' || canonical_key AS node_id, cand.segment_id, cand.document_id, sequence_index AS seq FROM cand JOIN segments USING (segment_id)))) WHERE rank <= 2", "cand"),
    "source_index": base.sql("SELECT segment_id, document_id, array_to_string(list_sort(list(DISTINCT canonical_key)), '|') AS nodes FROM cand GROUP BY 1, 2", "cand"),
    "summary_score": base.sql(f"SELECT document_id, md5(s) AS sentence_md5, (CASE WHEN length(s) < 20 THEN -10 WHEN length(s) <= 160 THEN 20 ELSE 5 END + CASE WHEN contains(s, '?') THEN 3 ELSE 0 END - 2 * len(regexp_extract_all(s, '[|#*$%&]')))::BIGINT AS score FROM (SELECT document_id, CASE WHEN regexp_matches(x, '[.?!]$') THEN x ELSE x || '.' END AS s FROM (SELECT 'writing:' || doc_id AS document_id, {_sent} AS x FROM w_lines))", "w_lines"),
    "frame_assignment": base.sql("SELECT * FROM placed", "placed"),
    "frame_scopes": base.sql("SELECT document_id, frame_idx, count(*) AS n, min(pos) AS lo, max(pos) AS hi, CASE WHEN count(*) >= any_value(nd) - 1 THEN 'document' ELSE 'section' END AS scope FROM placed JOIN (SELECT document_id, count(*) AS nd FROM placed GROUP BY 1) USING (document_id) GROUP BY 1, 2", "placed"),
    "longest_runs": base.sql("""SELECT document_id, frame_idx, start, start + n - 1 AS "end", n FROM (SELECT document_id, frame_idx, r.s AS start, r.n AS n FROM (SELECT document_id, frame_idx, arg_max({'s': s, 'n': n}, (n, -s)) AS r FROM (SELECT document_id, frame_idx, min(pos) AS s, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY document_id, frame_idx ORDER BY pos) AS i FROM (SELECT DISTINCT * FROM listed)) GROUP BY document_id, frame_idx, i) GROUP BY 1, 2))""", "listed"),
    "frame_contiguity": base.sql("SELECT document_id, frame_idx, max(pos) - min(pos) + 1 = count(DISTINCT pos) AS contiguous, count(DISTINCT pos) AS n FROM listed GROUP BY 1, 2", "listed"),
    "suppressed_frames": base.sql("SELECT document_id, frame_idx FROM (SELECT document_id, frame_idx, count(*) AS subs, count(*) FILTER (k = 1) AS single, sum(k) AS n FROM (SELECT document_id, frame_idx, pos % 4 AS s, count(DISTINCT pos) AS k FROM listed GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE n >= 3 AND subs >= 2 AND single / subs::DOUBLE >= 0.67", "listed"),
    "anchor_tokens": f"SELECT document_id, string_agg(t, ' ' ORDER BY r) AS anchors FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, t) AS r FROM (SELECT document_id, t, count(*) AS n FROM (SELECT 'writing:' || doc_id AS document_id, unnest({base.words_sql('text', 3, ASTOP)}) AS t FROM documents) GROUP BY 1, 2)) WHERE r <= 5 GROUP BY document_id",
    "frame_anchors": base.sql("SELECT * FROM fsup", "fsup"),
    "frame_families": base.sql("\nSELECT 1", "fpair").replace("WITH ", "WITH RECURSIVE ", 1).replace("\n\nSELECT 1", """,
fe AS (SELECT a, b FROM fpair UNION SELECT b, a FROM fpair), cc(id, comp) USING KEY (id) AS (SELECT DISTINCT a, a FROM fe UNION (SELECT e.a, min(c.comp) FROM cc c JOIN fe e ON e.b = c.id JOIN recurring.cc p ON p.id = e.a WHERE c.comp < p.comp GROUP BY e.a)),
coh AS (SELECT comp, sum(2 * shared)::BIGINT AS cohesion FROM fpair JOIN cc ON fpair.a = cc.id GROUP BY comp)
SELECT id AS frame_id, cc.comp AS family, count(*) OVER (PARTITION BY cc.comp) AS size, coalesce(cohesion, 0) AS cohesion FROM cc LEFT JOIN coh ON cc.comp = coh.comp""", 1),
    "frame_pairs": base.sql("SELECT a, b, shared FROM fpair", "fpair"),
    "segment_diff": base.sql("SELECT coalesce(n.segment_id, o.segment_id) AS segment_id, CASE WHEN o.segment_id IS NULL THEN 'added' WHEN n.segment_id IS NULL THEN 'removed' WHEN o.text_hash = n.text_hash THEN 'unchanged' ELSE 'changed' END AS change FROM inow n FULL JOIN iold o ON n.segment_id = o.segment_id", "inow", "iold"),
    "segment_hashes": base.sql("SELECT * FROM inow", "inow"),
    "pending_items": base.sql("SELECT segment_id, cache_key FROM inow WHERE cache_key NOT IN (SELECT cache_key FROM iold)", "inow", "iold"),
    "cache_resolution": base.sql("SELECT n.segment_id, CASE WHEN o.text_hash = n.text_hash THEN o.cache_key WHEN n.cache_key IN (SELECT cache_key FROM iold) THEN n.cache_key END AS entry FROM inow n LEFT JOIN iold o ON n.segment_id = o.segment_id", "inow", "iold"),
    "cache_upsert": base.sql("SELECT coalesce(n.segment_id, o.segment_id) AS segment_id, coalesce(n.text_hash, o.text_hash) AS text_hash FROM (SELECT * FROM inow WHERE substr(text_hash, 1, 1) < '8') n FULL JOIN iold o ON n.segment_id = o.segment_id", "inow", "iold"),
    "document_hashes": base.sql("SELECT document_id, sha256(string_agg(h, ',' ORDER BY h)) AS hash FROM (SELECT document_id, sha256(segment_id || '|' || text) AS h FROM segments WHERE source_kind <> 'chat') GROUP BY 1", "segments"),
    "affected_scope": base.sql("SELECT * FROM aff", "aff"),
    "scope_decision": base.sql("SELECT n AS n_families, a AS n_affected, r AS n_review, round(a / greatest(1, n)::DOUBLE, 6) AS share, CASE WHEN a / greatest(1, n)::DOUBLE >= 0.35 AND (a >= 60 OR a = n) THEN 'full_graph' ELSE 'none' END AS fallback FROM (SELECT count(*) AS n, count(*) FILTER (state IN ('added', 'changed')) AS a, count(*) FILTER (in_review) AS r FROM aff)", "aff"),
    "edge_dependencies": base.sql("SELECT family_id, count(DISTINCT i) AS n_in, count(DISTINCT o) AS n_out, count(DISTINCT nbr) AS n_neighbours FROM (SELECT src AS family_id, dst AS nbr, edge_id AS o, NULL AS i FROM edge WHERE src <> dst UNION ALL SELECT dst, src, NULL, edge_id FROM edge WHERE src <> dst) GROUP BY 1", "edge"),
    "coverage_by_kind": base.sql("SELECT k AS source_kind, coalesce(t, 0) AS n_total, coalesce(a, 0) AS n_anchored, CASE WHEN coalesce(t, 0) = 0 THEN 1.0::DOUBLE ELSE round(a / t::DOUBLE, 6) END AS share FROM (VALUES ('writing'), ('conversation'), ('chat')) v(k) LEFT JOIN (SELECT source_kind, count(*) AS t, count(*) FILTER (segment_id IN (SELECT segment_id FROM cand)) AS a FROM segments WHERE signal_kind = 'primary' GROUP BY 1) ON k = source_kind", "cand"),
    "weak_provenance": base.sql("SELECT split_part(canonical_key, '-', 1) AS family_id, count(DISTINCT canonical_key) AS n_members, count(DISTINCT segment_id) AS n_anchors FROM cand GROUP BY 1 HAVING count(DISTINCT canonical_key) > 1 AND count(DISTINCT segment_id) <= 1", "cand"),
    "one_off_nodes": base.sql("SELECT node_id FROM node WHERE n_conversation > 0 AND n_writing = 0 AND n_chat = 0 AND n_documents = 1", "node"),
    "state_proliferation": base.sql(f"""SELECT canonical_key, n_claims, n_states FROM (SELECT canonical_key, count(*) AS n_claims, count(DISTINCT state_no) AS n_states, bool_or(coalesce({base.jaccard_sql('tk', 'nx', 0.0)} >= 0.75, false)) AS al FROM (SELECT *, lead(tk) OVER (PARTITION BY canonical_key ORDER BY claim_no) AS nx FROM (SELECT canonical_key, claim_no, state_no, list_distinct(list_filter(string_split({base.slug_sql('claim')}, '-'), lambda t: length(t) >= 2)) AS tk FROM state)) GROUP BY 1) WHERE n_claims >= 2 AND n_states >= 2 AND n_states >= n_claims AND al""", "state"),
    "density_audit": base.sql("SELECT document_id, count(*) AS n_long, round(avg(c), 6) AS mean, count(*) < 3 OR avg(c) >= 1.5 AS passes FROM (SELECT s.document_id, s.segment_id, count(cand.segment_id) AS c FROM segments s LEFT JOIN cand ON s.segment_id = cand.segment_id WHERE s.signal_kind = 'primary' AND s.source_kind <> 'chat' AND length(s.text) >= 220 GROUP BY 1, 2) GROUP BY 1", "cand"),
    "turn_audit": "SELECT id, action, n_clean FROM (" + ingest.SANITIZE + ") WHERE action <> 'drop' ORDER BY n_clean DESC, id LIMIT 20",
    "frame_audit": base.sql("""SELECT code, count(*) AS n_issues, count(DISTINCT id) AS n_ids FROM (SELECT 'frame_not_contiguous' AS code, document_id || ':' || frame_idx AS id FROM (SELECT document_id, frame_idx FROM listed GROUP BY 1, 2 HAVING max(pos) - min(pos) + 1 <> count(DISTINCT pos)) UNION ALL SELECT 'single_segment_frame', document_id || ':' || frame_idx FROM (SELECT document_id, frame_idx FROM listed GROUP BY 1, 2 HAVING count(DISTINCT pos) = 1)
UNION ALL SELECT 'overlapping_segment', document_id || ':' || pos FROM (SELECT document_id, pos FROM listed GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'unassigned_segment', document_id || ':' || pos FROM lp WHERE pos % 7 = 0) GROUP BY code""", "listed"),
    "duplicate_texts": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "session_windows": """SELECT user_id, min(us) AS started_us, max(us) + 1800000000 AS ended_us, count(*) AS n_events, sum(v)::DOUBLE AS total FROM (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (SELECT user_id, event_id, epoch_us(ts) AS us, value::DECIMAL(18,4) AS v, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s""",
    "tumbling_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_events, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1, 2",
    "deduplicated_events": "SELECT DISTINCT event_id FROM events",
}
