"""Queries on ingest, normalising, the unified corpus and batches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import batching, corpus
from ..sources import conversations as C
from ..sources import transcripts
from . import base

MIN_TURNS = 4


def unified_segments(spark, sf_dir):
    return base.segments(spark, sf_dir).withColumn("preview", T.preview(F.col("text"))).drop("text")


def unified_timeline(spark, sf_dir):
    segs = base.segments(spark, sf_dir).drop("text")
    return corpus.timeline(segs, base.documents(spark, sf_dir)).select("chronology_index", "segment_id", "document_id", "title", "source_kind", "signal_kind", "sequence_index", "time_unix")


def document_rollup(spark, sf_dir):
    r = corpus.document_rollup(base.segments(spark, sf_dir))
    return r.select("document_id", "source_kind", "n_primary", "n_context", "time_unix", F.md5("primary_text").alias("primary_md5"), F.md5("context_text").alias("context_md5"))


def corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(base.segments(spark, sf_dir))


def text_metrics(spark, sf_dir):
    d, x = base.table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", T.count_words(x).alias("n_words"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"), T.token_estimate(x).alias("tokens4"), T.export_estimate(x).alias("tokens3"), F.sha2("text", 256).alias("text_sha256"))


def slug_titles(spark, sf_dir):
    t = F.col("title")
    return base.writings(spark, sf_dir).select("document_id", T.slugify(t).alias("slug"), F.array_join(T.tokens(t), " ").alias("tokens"), F.array_join(F.array_sort(T.title_tokens(t)), " ").alias("title_set"), T.signature(t, t).alias("signature"), F.array_join(T.keywords(t), " ").alias("keywords"), T.clip(t, 40).alias("clipped"))


def file_names(spark, sf_dir):
    """File names with and without a date suffix, made from events."""
    e = base.table(spark, sf_dir, "events")
    name = F.concat(F.lit("note "), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("_"), F.date_format("ts", "MM_dd_yyyy"))))
    return e.select("event_id", T.date_of_name(name).cast("string").alias("source_date"), T.label_of_name(name).alias("label"), T.slugify(name).alias("slug"))


def _transcript(spark, sf_dir):
    e = base.table(spark, sf_dir, "events")
    head = F.concat(F.lit("["), F.date_format("ts", "dd.MM.yyyy H:mm:ss"), F.lit("] user "), (F.col("event_id") % 3).cast("string"), F.lit(": "), F.col("event_type"))
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("  more "), "props")).when(F.col("event_type") == "error", F.concat(head, F.lit(" přidal/a vás"))).otherwise(head)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.concat(F.lit("chat:"), F.col("user_id").cast("string")).alias("chat_id"), n.alias("line_no"), line.alias("line"))


def transcript_messages(spark, sf_dir):
    return transcripts.messages(_transcript(spark, sf_dir), ("user 1",))


def chat_rollup(spark, sf_dir):
    r = transcripts.chats(transcripts.messages(_transcript(spark, sf_dir), ("user 1",)))
    return r.withColumn("participants", F.array_join("participants", "|"))


def chat_focus(spark, sf_dir):
    m = base.messages(spark, sf_dir).withColumn("ord", F.col("ord") - 1)
    return transcripts.focus_timeline(m, "chat_id", "ord", "role = 'owner'", "role = 'other'").select("chat_id", "pos", "ord", "side", "focus_ord")


def focus_timeline(spark, sf_dir):
    t = base.turns(spark, sf_dir)
    return transcripts.focus_timeline(t, "conversation_id", "ord", "role = 'user'", "role = 'assistant'").select("conversation_id", "pos", "ord", "side", "focus_ord")


def turn_sanitize(spark, sf_dir):
    """Turns and, as very long user turns, whole documents with pasted-text phrases in front."""
    t = base.turns(spark, sf_dir).select(F.concat_ws(":", "conversation_id", F.col("ord").cast("string")).alias("id"), "role", "text")
    lead = F.element_at(F.array(F.lit(""), F.lit("Tady to je text: "), F.lit("file contents\n\n"), F.lit("Toto je vynatek z knihy\n"), F.lit("do anything now ")), (F.col("doc_id") % 5 + 1).cast("int"))
    d = base.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.lit("user").alias("role"), F.concat(lead, "text").alias("text"))
    return C.sanitized(t.unionByName(d)).select("id", "action", "reason", F.length("clean").cast("long").alias("n_clean"), F.md5("clean").alias("clean_md5"))


def conversation_gate(spark, sf_dir):
    return C.inclusion(base.turns(spark, sf_dir), short=MIN_TURNS)


def work_classify(spark, sf_dir):
    t = base.turns(spark, sf_dir)
    first = t.groupBy("conversation_id").agg(F.min_by("text", "ord").alias("title"))
    vocabulary = {"system": ["app", "the*", "que*"], "implementation": ["of", "und", "en*"], "intent": ["and", "des", "is"]}
    return C.work_score(C.work_input(t).join(first, "conversation_id"), vocabulary, ["the*", "und", "que"])


#: A form of every entry of the work vocabulary, from which titles and bodies are dealt.
FORMS = [w.split("|")[0].replace("*", "ova") for ws in C.WORK.values() for w in ws]


def work_vocabulary(spark, sf_dir):
    """Conversations of one to nine words of the work vocabulary, scored by it."""
    words, n = F.array(*map(F.lit, FORMS)), len(FORMS)
    ids = base.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("c")).distinct()
    body = F.transform(F.sequence(F.lit(0), F.col("c") % 9), lambda j: F.element_at(words, ((F.col("c") * 3 + j * 7) % n + 1).cast("int")))
    return C.work_score(ids.select(F.concat(F.lit("conversation:"), F.col("c").cast("string")).alias("conversation_id"), F.element_at(words, (F.col("c") % n + 1).cast("int")).alias("title"), F.array_join(body, " ").alias("body")))


def role_counts(spark, sf_dir):
    return C.role_counts(base.turns(spark, sf_dir))


def active_chain(spark, sf_dir):
    """Each conversation as a tree with a dead branch at every third turn; the current node is its last turn."""
    t = base.table(spark, sf_dir, "conversations")
    own = t.select("conv_id", F.concat(F.lit("n"), F.col("turn").cast("string")).alias("node_id"), F.when(F.col("turn") > 0, F.concat(F.lit("n"), (F.col("turn") - 1).cast("string"))).alias("parent"), F.col("turn").cast("long").alias("time"))
    dead = t.where("turn % 3 = 1").select("conv_id", F.concat(F.lit("d"), F.col("turn").cast("string")).alias("node_id"), F.concat(F.lit("n"), (F.col("turn") - 1).cast("string")).alias("parent"), F.col("turn").cast("long").alias("time"))
    cur = t.groupBy("conv_id").agg(F.concat(F.lit("n"), F.max("turn").cast("string")).alias("current_node")).select("conv_id", F.when(F.col("conv_id") % 5 != 0, F.col("current_node")).alias("current_node"))
    nodes = own.unionByName(dead).join(cur, "conv_id").withColumnRenamed("conv_id", "conversation_id")
    return C.active_chain(nodes).select("conversation_id", F.col("ord").cast("long").alias("ord"), "node_id")


def content_payloads(spark, sf_dir):
    """Message contents of several shapes, made from turns, back to text."""
    t = base.turns(spark, sf_dir)
    k = F.col("ord") % 4
    payload = (
        F.when(k == 0, F.to_json(F.struct(F.lit("text").alias("content_type"), F.array("text", F.lit("")).alias("parts"))))
        .when(k == 1, F.to_json(F.struct(F.lit("code").alias("content_type"), "text")))
        .when(k == 2, F.to_json(F.struct(F.lit("thoughts").alias("content_type"), F.array(F.struct(F.lit("").alias("summary"), F.col("text").alias("content")), F.struct(F.lit("sum").alias("summary"), F.col("text").alias("content"))).alias("thoughts"))))
        .otherwise(F.to_json(F.struct(F.lit("tether_quote").alias("content_type"), F.lit("title").alias("title"), "text", F.lit("").alias("url"))))
    )
    return t.select("conversation_id", "ord", F.md5(C.content_text(payload)).alias("text_md5"))


def local_context(spark, sf_dir):
    n = corpus.neighbours(base.segments(spark, sf_dir))
    return n.select("segment_id", F.md5("before").alias("before_md5"), F.length("before").cast("long").alias("n_before"), F.md5("after").alias("after_md5"), F.length("after").cast("long").alias("n_after"))


def evidence_context(spark, sf_dir):
    e = corpus.expanded_evidence(base.segments(spark, sf_dir).where("source_kind <> 'chat'"))
    return e.select("segment_id", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"), F.length("evidence").cast("long").alias("n_evidence"))


def greedy_batches(spark, sf_dir):
    """Batches within each document, so that long corpora fold in parallel."""
    rows = batching.items(base.segments(spark, sf_dir).where("signal_kind = 'primary'"))
    return batching.batches(rows, ["document_id"], "sequence_index").select("document_id", "sequence_index", "tokens", "batch_no")


def batch_density(spark, sf_dir):
    """Per document and batch: items, tokens, and items of 220 characters or more."""
    segs = batching.items(base.segments(spark, sf_dir).where("signal_kind = 'primary'"))
    b = batching.batches(segs, ["document_id"], "sequence_index")
    long_ = segs.select("document_id", "sequence_index", (F.length("text") >= 220).alias("long_text"))
    return b.join(long_, ["document_id", "sequence_index"]).groupBy("document_id", "batch_no").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"), F.count_if("long_text").alias("n_long"))


def month_chronology(spark, sf_dir):
    s = base.segments(spark, sf_dir)
    month = F.coalesce(F.date_format(F.timestamp_millis("time_unix"), "yyyy-MM"), F.lit("unknown"))
    return s.groupBy(month.alias("month"), "source_kind").agg(F.count("*").alias("n_segments"), F.count_distinct("document_id").alias("n_documents"))


def source_mix(spark, sf_dir):
    """Which kinds of source share a token of a segment's start: counts by combination."""
    s = base.segments(spark, sf_dir).select("source_kind", F.get(T.tokens(F.col("text"), ()), F.lit(0)).alias("token")).where("token IS NOT NULL")
    per = s.groupBy("token").agg(F.array_join(F.array_sort(F.collect_set("source_kind")), "+").alias("mix"))
    return per.groupBy("mix").agg(F.count("*").alias("n_tokens"))


STOP = base.list_sql(T.MERGE_STOP)
TRIMMED = "trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"
TITLE = "coalesce(ls[1], '')"
SQUEEZED = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_sq = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_preview = lambda x: f"CASE WHEN length({_sq(x)}) <= 180 THEN {_sq(x)} ELSE substr({_sq(x)}, 1, 177) || '...' END"
TRANSCRIPT = """raw AS (SELECT 'chat:' || user_id AS chat_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id % 3 AS u, event_type, props, ts FROM events),
isl AS (SELECT *, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY n) AS ord FROM raw),
tm AS (SELECT chat_id, ord::BIGINT AS ord, max(CASE WHEN event_type <> 'view' THEN 'user ' || u END) AS author, max(CASE WHEN event_type <> 'view' THEN CASE WHEN event_type = 'error' THEN 'system' WHEN u = 1 THEN 'owner' ELSE 'other' END END) AS role,
  max(CASE WHEN event_type <> 'view' THEN epoch_ms(date_trunc('second', ts)) END) AS time_unix, string_agg(CASE WHEN event_type = 'view' THEN 'more ' || props WHEN event_type = 'error' THEN event_type || ' přidal/a vás' ELSE event_type END, chr(10) ORDER BY n) AS text
  FROM isl WHERE ord > 0 GROUP BY chat_id, ord)"""
FOCUS = """, f AS (SELECT g, ord AS focus_ord FROM items WHERE focus), r AS (SELECT g, focus_ord, focus_ord + d AS ord, CASE WHEN d < 0 THEN -1 ELSE 1 END AS side FROM f, (VALUES (-1), (1)) AS v(d)),
k AS (SELECT g, ord, min({'focus_ord': focus_ord, 'side': side}) AS m FROM r GROUP BY g, ord),
o AS (SELECT g, ord, ord AS focus_ord, 0 AS side FROM items WHERE focus UNION ALL SELECT items.g, items.ord, m.focus_ord, m.side FROM items JOIN k ON items.g = k.g AND items.ord = k.ord WHERE ctx AND NOT focus)
SELECT g AS %s, row_number() OVER (PARTITION BY g ORDER BY focus_ord, side, ord) AS pos, ord, side, focus_ord FROM o"""
BATCHED = "RECURSIVE it AS (SELECT document_id, sequence_index, row_number() OVER (PARTITION BY document_id ORDER BY sequence_index) AS i, greatest(1, ceil(length(text) / 4.0))::BIGINT + 40 AS tokens, length(text) >= 220 AS long_text FROM segments WHERE signal_kind = 'primary'), b AS (SELECT document_id, sequence_index, i, tokens, long_text, 0::BIGINT AS batch_no, 1 AS cnt, tokens AS used FROM it WHERE i = 1 UNION ALL SELECT it.document_id, it.sequence_index, it.i, it.tokens, it.long_text, CASE WHEN cnt >= 32 OR used + it.tokens > 8000 THEN batch_no + 1 ELSE batch_no END, CASE WHEN cnt >= 32 OR used + it.tokens > 8000 THEN 1 ELSE cnt + 1 END, CASE WHEN cnt >= 32 OR used + it.tokens > 8000 THEN it.tokens ELSE used + it.tokens END FROM b JOIN it ON b.document_id = it.document_id AND b.i + 1 = it.i)"
_batched = lambda q: base.sql("", "segments").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + BATCHED.removeprefix("RECURSIVE ") + "\n" + q
_hits = lambda x, words: " + ".join(f"len(regexp_extract_all({x}, '\\b(?:{w.replace('*', '[A-Za-z0-9_]*')})\\b'))" for w in words)
_ordtext = "string_agg(text, chr(10) || chr(10) ORDER BY sequence_index)"

_NEAR = [f"{f}({{c}}, {d}) OVER w" for d in (1, 2, 3) for f in ("lag", "lead")]
_STEPS = "t0 AS (SELECT segment_id, length(text) AS base, length(text) AS size, [sequence_index] AS places, " + ", ".join(f"{n.format(c='sequence_index')} AS s{k}, length({n.format(c='text')}) AS n{k}" for k, n in enumerate(_NEAR)) + " FROM segments WHERE source_kind <> 'chat' WINDOW w AS (PARTITION BY document_id, signal_kind, author_kind ORDER BY sequence_index))"
for _k in range(6):
    _take = f"base < 320 AND n{_k} IS NOT NULL AND size + n{_k} <= 700"
    _STEPS += f", t{_k + 1} AS (SELECT * REPLACE (CASE WHEN {_take} THEN size + n{_k} ELSE size END AS size, CASE WHEN {_take} THEN list_append(places, s{_k}) ELSE places END AS places) FROM t{_k})"

_ws = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_tidy = lambda x: _ws(f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_has = lambda x, ps: "regexp_matches(" + x + ", '(?i)" + "|".join(f"(?:{p})" for p in ps) + "')"
_many = lambda x, ps: "(" + " + ".join(f"regexp_matches({x}, '(?i){p}')::INT" for p in ps) + ")"
_n = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
SANITIZE = rf"""WITH raw AS (SELECT 'conversation:' || conv_id || ':' || turn AS id, role, text FROM conversations UNION ALL SELECT 'doc:' || doc_id, 'user', ['', 'Tady to je text: ', 'file contents' || chr(10) || chr(10), 'Toto je vynatek z knihy' || chr(10), 'do anything now '][doc_id % 5 + 1] || text FROM documents),
a AS (SELECT id, role, {_ws("replace(replace(text, chr(13) || chr(10), chr(10)), chr(12), chr(10))")} AS t FROM raw),
b AS (SELECT *, substr(t, 1, 1600) AS h, substr(t, 1, 320) AS h3, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_ws('x')}), lambda x: x <> '') AS ls, strpos(t, chr(10) || chr(10)) - 1 AS para, strpos(t, chr(10)) - 1 AS line FROM a),
c AS (SELECT *, length(regexp_extract(h3, '(?s)^(.*[.?!:]) ', 1)) - 1 AS stop, CASE WHEN len(ls) = 0 THEN 0 ELSE len(list_filter(ls, lambda x: length(x) <= 80)) / len(ls)::DOUBLE END AS sh, {_tidy("regexp_extract(t, '(?is)^(.*?)" + C.BODY_MARKER + "', 1)")} AS bm FROM b),
d AS (SELECT *, CASE WHEN t = '' THEN '' WHEN para > 0 AND para <= 640 THEN {_tidy('substr(t, 1, para)')} WHEN line > 0 AND line <= 320 THEN {_tidy('substr(t, 1, line)')} WHEN stop >= 40 THEN {_tidy('substr(h3, 1, stop + 1)')} ELSE {_tidy('h3')} END AS intro,
  length(t) >= 40000 AND {_many('h', C.ACADEMIC)} >= 2 AS acad FROM c),
e AS (SELECT *, CASE WHEN role <> 'user' THEN 'keep' WHEN t = '' THEN 'empty_user_turn' WHEN length(t) < 4000 THEN 'keep' WHEN {_has('h', C.PROMPTS)} THEN 'prompt_dump' WHEN {_has('h', C.EXPLICIT)} THEN 'explicit_pasted_document' WHEN {_has('h', C.TRANSPORT)} AND {_has('h', C.OBJECTS)} THEN 'transport_preface_plus_document_dump'
  WHEN bm <> '' THEN 'intro_before_external_body' WHEN {_has('h', C.INTRO)} THEN 'intro_plus_external_excerpt'
  WHEN length(t) >= 8000 AND len(ls) >= 120 AND sh >= 0.45 AND ({_n('t', r'(?i)https?://')} >= 2 OR {_n('t', r'(?m)^\s*[-*•]')} >= 6 OR {_n('t', r'(?m):\s*$')} >= 6) AND {_many('h', C.OBJECTS)} >= 2 THEN 'structured_document_dump' WHEN acad THEN 'academic_abstract_dump'
  WHEN length(t) >= 8000 AND (regexp_matches(substr(t, 1, 160), '^\s*\d+(?:[.-]\d+)+(?:\s+|$)') OR regexp_matches(substr(t, 1, 160), '^\s*\d+\.\s*[A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ]') OR regexp_matches(substr(t, 1, 160), '(?i)^\s*[IVXLC]+\.\s+')) AND (acad OR {_n('t', r'(?i)[a-záčďéěíňóřšťúůýž]{2,}-\n[a-záčďéěíňóřšťúůýž]{2,}')} >= 2 OR sh >= 0.35) THEN 'chapter_or_ocr_excerpt_dump' ELSE 'keep' END AS r FROM d),
f AS (SELECT id, r, CASE WHEN r = 'keep' THEN t WHEN r = 'intro_before_external_body' THEN bm WHEN r IN ('explicit_pasted_document', 'transport_preface_plus_document_dump', 'intro_plus_external_excerpt') THEN intro ELSE '' END AS clean FROM e)
SELECT id, CASE WHEN r = 'keep' THEN 'keep' WHEN clean = '' THEN 'drop' ELSE 'trim' END AS action, CASE WHEN r <> 'keep' THEN r END AS reason, length(clean)::BIGINT AS n_clean, md5(clean) AS clean_md5 FROM f"""

QUERIES = {
    f.__name__: f
    for f in (
        unified_segments, unified_timeline, document_rollup, corpus_stats, text_metrics, slug_titles, file_names, transcript_messages, chat_rollup, chat_focus, focus_timeline, turn_sanitize,
        conversation_gate, work_classify, work_vocabulary, role_counts, active_chain, content_payloads, local_context, evidence_context, greedy_batches, batch_density, month_chronology, source_mix,
    )
}

SQL = {
    "unified_segments": base.sql(f"SELECT * EXCLUDE (text), {_preview('text')} AS preview FROM segments", "segments"),
    "unified_timeline": base.sql(
        f"""SELECT row_number() OVER (ORDER BY time_unix NULLS LAST, s.document_id, sequence_index, segment_id) AS chronology_index, segment_id, s.document_id, CASE WHEN source_kind = 'writing' THEN {TITLE} ELSE s.document_id END AS title, source_kind, signal_kind, sequence_index, time_unix
FROM segments s LEFT JOIN w_lines w ON s.document_id = 'writing:' || w.doc_id""", "segments"),
    "document_rollup": base.sql(f"SELECT document_id, source_kind, count(*) FILTER (signal_kind = 'primary') AS n_primary, count(*) FILTER (signal_kind = 'context') AS n_context, min(time_unix) AS time_unix, md5(coalesce({_ordtext} FILTER (signal_kind = 'primary'), '')) AS primary_md5, md5({_ordtext} FILTER (signal_kind = 'context')) AS context_md5 FROM segments GROUP BY document_id, source_kind", "segments"),
    "corpus_stats": base.sql("SELECT count(DISTINCT document_id) AS n_documents, count(*) AS n_segments, count(*) FILTER (signal_kind = 'primary') AS n_primary, count(*) FILTER (signal_kind = 'context') AS n_context, count(*) FILTER (source_kind = 'writing') AS n_writing, count(*) FILTER (source_kind = 'conversation') AS n_conversation, count(*) FILTER (source_kind = 'chat') AS n_chat FROM segments", "segments"),
    "text_metrics": f"SELECT doc_id, (CASE WHEN {TRIMMED} = '' THEN 0 ELSE len(regexp_split_to_array({TRIMMED}, '\\s+')) END)::BIGINT AS n_words, len(string_split(text, chr(10)))::BIGINT AS n_lines, length(text)::BIGINT AS n_chars, strlen(text)::BIGINT AS n_bytes, greatest(1, ceil(length({TRIMMED}) / 4.0))::BIGINT AS tokens4, ceil(length(text) / 3.0)::BIGINT AS tokens3, sha256(text) AS text_sha256 FROM documents",
    "slug_titles": base.sql(
        f"""SELECT 'writing:' || doc_id AS document_id, {base.slug_sql('t')} AS slug, array_to_string({base.words_sql('t', 3, STOP)}, ' ') AS tokens, array_to_string(list_sort(list_distinct(list_filter(string_split({base.slug_sql('t')}, '-'), lambda x: length(x) >= 2))), ' ') AS title_set,
array_to_string(list_sort(list_slice({base.words_sql('t', 3, STOP)}, 1, 4)), '-') AS signature, array_to_string(list_sort(list_distinct({base.words_sql('t', 2)})), ' ') AS keywords, CASE WHEN length({_sq('t')}) <= 40 THEN {_sq('t')} ELSE rtrim(substr({_sq('t')}, 1, 39)) || '…' END AS clipped FROM (SELECT doc_id, {TITLE} AS t FROM w_lines)""", "w_lines"),
    "file_names": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts::DATE::VARCHAR END AS source_date, 'note ' || event_type AS label, 'note-' || event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE strftime(ts, '-%m-%d-%Y') END AS slug FROM events",
    "transcript_messages": f"WITH {TRANSCRIPT} SELECT * FROM tm",
    "chat_rollup": f"WITH {TRANSCRIPT} SELECT chat_id, coalesce(array_to_string(list_sort(list(DISTINCT author) FILTER (role <> 'system')), '|'), '') AS participants, arg_min(ord, (time_unix, ord)) AS first_ord, arg_max(ord, (time_unix, ord)) AS last_ord, count(*) AS n_messages, count(*) FILTER (role = 'owner') AS n_owner, count(*) FILTER (role = 'other') AS n_other, count(*) FILTER (role = 'system') AS n_system FROM tm GROUP BY chat_id",
    "chat_focus": base.sql("", "msgs").rstrip() + ", items AS (SELECT chat_id AS g, ord - 1 AS ord, role = 'owner' AS focus, role = 'other' AS ctx FROM msgs)" + FOCUS % "chat_id",
    "focus_timeline": "WITH items AS (SELECT 'conversation:' || conv_id AS g, turn AS ord, role = 'user' AS focus, role = 'assistant' AS ctx FROM conversations)" + FOCUS % "conversation_id",
    "turn_sanitize": SANITIZE,
    "conversation_gate": f"""WITH c AS (SELECT conv_id, count(*) AS n, coalesce(bool_or(role <> 'system' AND contains(text, '```')), false) AS f FROM conversations GROUP BY conv_id)
SELECT 'conversation:' || conv_id AS conversation_id, n AS n_turns, f AS has_fence, n > {MIN_TURNS} AND NOT f AS include, CASE WHEN n <= {MIN_TURNS} THEN 'excluded_null_gizmo_short' WHEN f THEN 'excluded_null_gizmo_code' ELSE 'null_gizmo_long_non_code' END AS reason FROM c""",
    "work_classify": f"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY turn), 1, 8000) AS body FROM u WHERE r <= 6 GROUP BY conv_id),
t AS (SELECT conv_id, arg_min(text, turn) AS title FROM conversations GROUP BY conv_id), n AS (SELECT conv_id, strip_accents(lower(title || chr(10) || chr(10) || body)) AS n, strip_accents(lower(title)) AS t FROM b JOIN t USING (conv_id)),
h AS (SELECT conv_id, {_hits('n', ['app', 'the*', 'que*'])} AS a, {_hits('n', ['of', 'und', 'en*'])} AS b, {_hits('n', ['and', 'des', 'is'])} AS c, {_hits('t', ['app', 'the*', 'que*', 'of', 'und', 'en*', 'and', 'des', 'is'])} AS th, {' + '.join(f"regexp_matches(n, '{chr(92)}b{w}{chr(92)}b')::INT" for w in ('the[A-Za-z0-9_]*', 'und', 'que'))} AS s FROM n)
SELECT 'conversation:' || conv_id AS conversation_id, a::INT AS system_hits, b::INT AS implementation_hits, c::INT AS intent_hits, th::INT AS title_hits, s AS strong, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS buckets, (a + b + c)::INT AS hits, (3 * ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT) + a + b + c + least(th, 2))::INT AS score,
(a > 0)::INT + (b > 0)::INT + (c > 0)::INT >= 2 AND a + b + c >= 5 AND s >= 2 AND (th >= 1 OR greatest(a, b, c) >= 3) AS exclude FROM h""",
    "work_vocabulary": f"""WITH n AS (SELECT c AS conv_id, {base.list_sql(FORMS)}[c % {len(FORMS)} + 1] AS t, {base.list_sql(FORMS)}[c % {len(FORMS)} + 1] || chr(10) || chr(10) || array_to_string(list_transform(range(0, c % 9 + 1), lambda j: {base.list_sql(FORMS)}[(c * 3 + j * 7) % {len(FORMS)} + 1]), ' ') AS n FROM (SELECT DISTINCT conv_id::BIGINT AS c FROM conversations)),
h AS (SELECT conv_id, {_hits('n', C.WORK['system'])} AS a, {_hits('n', C.WORK['implementation'])} AS b, {_hits('n', C.WORK['intent'])} AS c, {_hits('t', [w for ws in C.WORK.values() for w in ws])} AS th, {' + '.join(f"regexp_matches(n, '{chr(92)}b(?:{w.replace('*', '[A-Za-z0-9_]*')}){chr(92)}b')::INT" for w in C.STRONG)} AS s FROM n)
SELECT 'conversation:' || conv_id AS conversation_id, a::INT AS system_hits, b::INT AS implementation_hits, c::INT AS intent_hits, th::INT AS title_hits, s AS strong, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS buckets, (a + b + c)::INT AS hits, (3 * ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT) + a + b + c + least(th, 2))::INT AS score,
(a > 0)::INT + (b > 0)::INT + (c > 0)::INT >= 2 AND a + b + c >= 5 AND s >= 2 AND (th >= 1 OR greatest(a, b, c) >= 3) AS exclude FROM h""",
    "role_counts": "SELECT 'conversation:' || conv_id AS conversation_id, count(*) AS n_turns, " + ", ".join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in ("user", "assistant", "tool", "system")) + ", 0::BIGINT AS n_unknown FROM conversations GROUP BY conv_id",
    "active_chain": """WITH n AS (SELECT conv_id, 'n' || turn AS id, turn AS t FROM conversations UNION ALL SELECT conv_id, 'd' || turn, turn FROM conversations WHERE turn % 3 = 1)
SELECT conv_id AS conversation_id, turn AS ord, 'n' || turn AS node_id FROM conversations WHERE conv_id % 5 <> 0 UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t, id) - 1, id FROM n WHERE conv_id % 5 = 0""",
    "content_payloads": "SELECT 'conversation:' || conv_id AS conversation_id, turn AS ord, md5(CASE turn % 4 WHEN 2 THEN text || chr(10) || chr(10) || 'sum' WHEN 3 THEN 'title' || chr(10) || text ELSE text END) AS text_md5 FROM conversations",
    "local_context": base.sql("""SELECT segment_id, md5(b) AS before_md5, length(b)::BIGINT AS n_before, md5(a) AS after_md5, length(a)::BIGINT AS n_after FROM (SELECT segment_id, CASE WHEN length(p) <= 2000 THEN p ELSE '[...]' || chr(10) || right(p, 2000) END AS b, CASE WHEN length(q) <= 2000 THEN q ELSE left(q, 2000) || chr(10) || '[...]' END AS a
FROM (SELECT segment_id, lag(text) OVER w AS p, lead(text) OVER w AS q FROM segments WHERE signal_kind = 'primary' WINDOW w AS (PARTITION BY document_id ORDER BY sequence_index)))""", "segments"),
    "evidence_context": base.sql("SELECT segment_id, array_to_string(list_sort(places), ',') AS places, (size + len(places) - 1)::BIGINT AS n_evidence FROM t6", "segments").replace("\nSELECT segment_id, array_to_string(list_sort(places)", ", " + _STEPS + "\nSELECT segment_id, array_to_string(list_sort(places)", 1),
    "greedy_batches": _batched("SELECT document_id, sequence_index, tokens, batch_no FROM b"),
    "batch_density": _batched("SELECT document_id, batch_no, count(*) AS n_items, sum(tokens)::BIGINT AS tokens, count(*) FILTER (long_text) AS n_long FROM b GROUP BY document_id, batch_no"),
    "month_chronology": base.sql("SELECT coalesce(strftime(make_timestamp_ms(time_unix), '%Y-%m'), 'unknown') AS month, source_kind, count(*) AS n_segments, count(DISTINCT document_id) AS n_documents FROM segments GROUP BY 1, 2", "segments"),
    "source_mix": base.sql(f"SELECT mix, count(*) AS n_tokens FROM (SELECT token, array_to_string(list_sort(list(DISTINCT source_kind)), '+') AS mix FROM (SELECT source_kind, {base.words_sql('text', 3)}[1] AS token FROM segments) WHERE token IS NOT NULL GROUP BY token) GROUP BY mix", "segments"),
}
