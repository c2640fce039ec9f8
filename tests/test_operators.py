"""Scenarios and brute-force comparisons for operators that SQL does not state."""

import itertools
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import audit, batching, families, graph, incremental, resolve, salience, similarity
from strandline.sources import conversations as C
from strandline.sources import files, transcripts
from strandline.streaming import events as S


def naive_sweep(ids, pairs, vetoes):
    """Groups by plain loops over all pairs until nothing changes."""
    group = {i: {i} for i in ids}
    ok, no = set(pairs) | {(b, a) for a, b in pairs}, set(vetoes) | {(b, a) for a, b in vetoes}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(ids, 2):
            x, y = group[a], group[b]
            if x is y or any((p, q) in no for p in x for q in y) or not any((p, q) in ok for p in x for q in y):
                continue
            x |= y
            for i in y:
                group[i] = x
            changed = True
    return {i: min(group[i]) for i in ids}


@settings(max_examples=400, deadline=None)
@given(st.integers(2, 9).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1))), st.sets(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=6))))
def test_sweeps_equal_plain_loops(case):
    n, pairs, vetoes = case
    pairs, vetoes = {p for p in pairs if p[0] != p[1]}, {v for v in vetoes if v[0] != v[1]}
    ids = list(range(n))
    assert resolve.sweep_unions(ids, sorted(pairs), vetoes) == naive_sweep(ids, pairs, vetoes)


def test_components_are_resolved_apart(spark):
    """Vetoes stand between groups, and components of pairs give the sequential result over all."""
    r = random.Random(5)
    ids = [f"k{i:02d}" for i in range(60)]
    pairs = sorted({tuple(sorted(r.sample(ids, 2))) for _ in range(70)})
    vetoes = {tuple(r.sample(ids, 2)) for _ in range(40)}
    key = spark.createDataFrame([(i,) for i in ids], "key string")
    frames = [spark.createDataFrame(list(x), "a string, b string") for x in (pairs, vetoes)]
    got = {x["key"]: x["root"] for x in resolve.resolve(key, *frames, resolve.sweep_unions).collect()}
    assert got == naive_sweep(ids, pairs, vetoes)
    greedy = {x["key"]: x["root"] for x in resolve.resolve(key, *frames).collect()}
    assert greedy == resolve.greedy_unions(ids, pairs, vetoes)


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(80):02d}", f"n{r.randrange(80):02d}") for _ in range(60)] + [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(120)]
    got = {x["node"]: x["root"] for x in graph.connected(spark.createDataFrame(edges, "src string, dst string")).collect()}
    nodes = sorted({x for e in edges for x in e})
    assert got == naive_sweep(nodes, {e for e in edges if e[0] != e[1]}, set())
    assert graph.connected(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_similar_pairs_lose_nothing(spark):
    r = random.Random(9)
    sets = [(f"d{k:03d}", [r.choice("abcdefghijkl") for _ in range(r.randint(0, 9))]) for k in range(150)]
    got = {(x["a"], x["b"]): round(x["score"], 6) for x in similarity.similar_pairs(spark.createDataFrame(sets, "id string, items array<string>"), 0.72).collect()}
    want = {}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        a, b = set(a), set(b)
        if a and b and len(a & b) / len(a | b) >= 0.72:
            want[(i, j)] = round(len(a & b) / len(a | b), 6)
    assert got == want


@pytest.mark.parametrize(("tokens", "size", "budget", "want"), [([1] * 5, 2, 99, [0, 0, 1, 1, 2]), ([600, 600, 10], 9, 650, [0, 1, 1]), ([600, 600, 60], 9, 650, [0, 1, 2]), ([999], 3, 5, [0]), ([], 3, 5, []), ([9, 1, 1], 3, 5, [0, 1, 1])])
def test_batches(spark, tokens, size, budget, want):
    import numpy as np

    assert batching.starts(np.array(tokens, np.int64), size, budget).tolist() == want
    rows = spark.createDataFrame([("g", k, t) for k, t in enumerate(tokens)], "g string, k long, tokens long")
    assert [r["batch_no"] for r in batching.batches(rows, ["g"], "k", size, budget).orderBy("k").collect()] == want


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_text_kernel(spark):
    x = F.col("x")
    assert one(spark, T.slugify(x), x="  Žluťoučký Kůň & co. ") == "zlutoucky-kun-co"
    assert one(spark, T.js_trim(x), x="\xa0\n a b \t") == "a b"
    assert [one(spark, T.count_words(x), x=v) for v in ("", " a  b\nc ", " ")] == [0, 3, 0]
    assert one(spark, T.first_line(x), x="\n  \n Title \nmore") == "Title" and one(spark, T.first_line(x), x=" \n") is None
    assert one(spark, T.preview(x), x="a" * 181) == "a" * 177 + "..." and one(spark, T.preview(x), x="b" * 180) == "b" * 180
    assert one(spark, T.tokens(x), x="The Ideas of ideas, a Být") == ["ideas", "ideas"]
    assert [one(spark, T.token_estimate(x), x=v) for v in ("", "abcd", "abcdefgh")] == [1, 1, 2]
    assert [str(one(spark, T.date_of_name(x), x=v)) for v in ("note_01_20_2024", "note_02_31_2024", "note")] == ["2024-01-20", "None", "None"]
    assert one(spark, T.label_of_name(x), x="my note -_01_20_2024") == "my note"
    assert one(spark, T.jaccard(F.array(), F.array())) == 1.0 and one(spark, T.jaccard(F.array(), F.array(), 0.0)) == 0.0
    assert one(spark, T.relation_key(F.lit("co_occurs"), F.lit("b"), F.lit("a"))) == "co_occurs:a:b" and one(spark, T.relation_key(F.lit("revises"), F.lit("b"), F.lit("a"))) == "revises:b:a"
    assert one(spark, T.intro_prefix(x), x="Look at  this:\n\nlong text") == "Look at this:"
    assert one(spark, T.intro_prefix(x), x="w " * 100 + "end. " + "z" * 400).endswith("end.")
    assert one(spark, T.clean_evidence(x), x="[image] see [doc](file:/x)\n\n  a   b") == "see doc\na b"
    assert len(one(spark, T.after_context(x), x="c" * 6000)) < 2100 and one(spark, T.before_context(x), x="d" * 6000).startswith("[...]")


def turn(spark, text, role="user"):
    return C.sanitized(spark.createDataFrame([(role, text)], "role string, text string")).first()


def test_turn_sanitiser(spark):
    pad = "word " * 900
    cases = [
        ("short", "keep", None), ("  ", "drop", "empty_user_turn"), (pad, "keep", None), ("Do anything now. " + pad, "drop", "prompt_dump"), ("File contents\n\n" + pad, "trim", "explicit_pasted_document"),
        ("Posilam sem kapitolu:\n" + pad, "trim", "transport_preface_plus_document_dump"), ("My view. Toto jsou jejich Terms & Conditions: " + pad, "trim", "intro_before_external_body"), ("Toto je vynatek z knihy\n" + pad, "trim", "intro_plus_external_excerpt"),
        ("api json\n" + "https://x\n" * 130 + pad * 2, "drop", "structured_document_dump"), ("Here we present a study (n = 12) " + "w " * 20000, "drop", "academic_abstract_dump"), ("1.2 Chapter\n" + "line\n" * 2000, "drop", "chapter_or_ocr_excerpt_dump"),
    ]
    for text, action, reason in cases:
        got = turn(spark, text)
        assert (got["action"], got["reason"]) == (action, reason), text[:40]
    assert turn(spark, "My view. Toto jsou jejich Terms & Conditions: " + pad)["clean"] == "My view."
    assert turn(spark, "do anything now " + pad, "assistant")["action"] == "keep"
    rows = [("c", 0, "user", "do anything now " + pad), ("c", 1, "user", "fine"), ("c", 2, "assistant", "ok")]
    assert [r["ord"] for r in C.kept_turns(spark.createDataFrame(rows, "conversation_id string, ord long, role string, text string")).orderBy("ord").collect()] == [1, 2]


def test_inclusion_gate(spark):
    rows = [(c, k, "user", "```x" if c == "code" and k == 3 else "t") for c, n in (("long", 11), ("short", 10), ("code", 11), ("own", 30)) for k in range(n)] + [("wrapped", k, "system" if k == 0 else "user", "```" if k == 0 else "t") for k in range(12)]
    groups = spark.createDataFrame([("own", "g-1")], "conversation_id string, group_id string")
    got = {r["conversation_id"]: r["reason"] for r in C.inclusion(spark.createDataFrame(rows, "conversation_id string, ord long, role string, text string"), groups).collect()}
    assert got == {"long": "null_gizmo_long_non_code", "short": "excluded_null_gizmo_short", "code": "excluded_null_gizmo_code", "own": "excluded_gizmo", "wrapped": "null_gizmo_long_non_code"}


def test_work_filter(spark):
    rows = [("work", "Backend aplikace", "python api endpoint json deploy specifikace databáze"), ("essay", "O svobodě", "projekt a dokument v politice, jedno api"), ("plain", "Walk", "trees and rivers")]
    got = {r["conversation_id"]: r for r in C.work_score(spark.createDataFrame(rows, "conversation_id string, title string, body string")).collect()}
    assert got["work"]["exclude"] and not got["essay"]["exclude"] and not got["plain"]["exclude"]
    w = got["work"]
    assert w["score"] == 3 * w["buckets"] + w["hits"] + min(w["title_hits"], 2)


def test_content_shapes(spark):
    shapes = [
        ({"content_type": "text", "parts": ["a", "", "b"]}, "a\nb"), ({"content_type": "multimodal_text", "parts": [{"content_type": "image_asset_pointer"}, "c"]}, "[image]\nc"), ({"content_type": "code", "text": "x = 1"}, "x = 1"),
        ({"content_type": "thoughts", "thoughts": [{"summary": "s", "content": "c"}, {"summary": "", "content": "d"}]}, "s\n\nd"), ({"content_type": "reasoning_recap", "content": "r"}, "r"), ({"content_type": "tether_quote", "title": "t", "text": "q", "url": "u"}, "t\nq\nu"),
        ({"content_type": "user_editable_context", "user_profile": "p", "user_instructions": "i"}, "p\ni"), ({"content_type": "sonic_webpage", "title": "t", "snippet": "s", "text": "x"}, "t\ns\nx"), ({"content_type": "other", "text": "z"}, "z"),
    ]
    df = spark.createDataFrame([(json.dumps(a), b) for a, b in shapes], "c string, want string").withColumn("got", C.content_text(F.col("c")))
    for r in df.collect():
        assert r["got"] == r["want"]
    assert one(spark, C.role_of(F.lit("user"), F.lit("user_editable_context"))) == "system"


def test_active_chain(spark):
    rows = [("a", "r", None, "z", 1), ("a", "x", "r", "z", 2), ("a", "dead", "r", "z", 3), ("a", "z", "x", "z", 4), ("b", "m", None, None, 2), ("b", "k", None, None, 1), ("loop", "p", "q", "p", 1), ("loop", "q", "p", "p", 2)]
    got = {}
    for r in C.active_chain(spark.createDataFrame(rows, "conversation_id string, node_id string, parent string, current_node string, time long")).orderBy("conversation_id", "ord").collect():
        got.setdefault(r["conversation_id"], []).append(r["node_id"])
    assert got == {"a": ["r", "x", "z"], "b": ["k", "m"], "loop": ["q", "p"]}


def test_transcript_and_focus(spark, tmp_path):
    text = "lost line\n‎[01.02.2024 9:05:07] Ann: hello\n  second line\n\n[01.02.2024 9:06:00] Me : hi\n[01.02.2024 9:07:00] Me : Ann přidal/a vás\n[bad] x\n[02.02.2024 10:00:00] Bob: bye"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "my chat.txt").write_text(text)
    rows = transcripts.messages(files.read_transcripts(spark, str(tmp_path)), ("Me",))
    got = [(r["author"], r["role"], r["text"]) for r in rows.orderBy("ord").collect()]
    assert got == [("Ann", "other", "hello\nsecond line"), ("Me", "owner", "hi"), ("Me", "system", "Ann přidal/a vás\n[bad] x"), ("Bob", "other", "bye")]
    c = transcripts.chats(rows).first()
    assert c["chat_id"] == "chat:my-chat" and c["participants"] == ["Ann", "Bob", "Me"] and (c["first_ord"], c["last_ord"], c["n_system"]) == (1, 4, 1)
    f = transcripts.focus_timeline(rows.withColumn("ord", F.col("ord") - 1), "chat_id", "ord", "role = 'owner'", "role = 'other'")
    assert [(r["pos"], r["ord"], r["side"]) for r in f.orderBy("pos").collect()] == [(1, 0, -1), (2, 1, 0)]


def test_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "note_01_20_2024.txt").write_text("Title\n\nFirst.\n\nSecond.")
    (d / ".gitkeep").write_text("")
    (d / "b.json").write_text('[{"id": "1"}, {"id": "2"}]')
    (d / "c.json").write_text('{"id": "3"}')
    found = files.discover(spark, str(d), "writing")
    assert found.count() == 1 and files.manifest(found).first()["n"] == 1 and files.discover(spark, str(d / "none"), "writing").count() == 0
    w = files.writing_records(files.read_writings(spark, str(d))).first()
    assert (w["title"], str(w["source_date"]), w["file_label"], w["line_count"], w["word_count"]) == ("Title", "2024-01-20", "note", 5, 3)
    assert sorted(r["id"] for r in files.read_bundle(spark, str(d), "id: string").collect()) == ["1", "2"]
    out = str(tmp_path / "out")
    files.write_tables({"a": found, "b": found.select("path")}, out)
    assert set(files.load_tables(spark, out, ("a", "b"))) == {"a", "b"}
    with pytest.raises(FileNotFoundError):
        files.load_tables(spark, out, ("a", "zzz"))
    files.append_batches(spark.createDataFrame([(1, "x")], "batch_id int, v string"), f"{out}/batches")
    files.append_batches(spark.createDataFrame([(2, "y")], "batch_id int, v string"), f"{out}/batches")
    assert files.load_batches(spark, f"{out}/batches").count() == 2
    files.write_pages(spark.createDataFrame([("p", "# body")], "name string, body string"), f"{out}/pages")
    assert files.remove_outputs(spark, out) == 4 and files.remove_outputs(spark, out) == 0


def test_paragraphs_drop_a_title(spark):
    from strandline.operators import corpus

    rows = [("w:1", "Title", "Title\n\nFirst.\n \n\nSecond.", None), ("w:2", "Only", "Only", None), ("w:3", "T", "Other\n\nT", 5)]
    segs = corpus.writing_segments(spark.createDataFrame(rows, "document_id string, title string, body string, time_unix long"))
    assert [(r["document_id"], r["sequence_index"], r["text"]) for r in segs.orderBy("document_id", "sequence_index").collect()] == [("w:1", 1, "First."), ("w:1", 2, "Second."), ("w:2", 1, "Only"), ("w:3", 1, "Other"), ("w:3", 2, "T")]
    assert [(r["segment_id"], r["chronology_index"]) for r in corpus.timeline(segs).orderBy("chronology_index").collect()][:2] == [("w:3:paragraph:1", 1), ("w:3:paragraph:2", 2)]


def test_review_acceptance(spark):
    cols = "revision long, blocking long, title_score double, key_score double, alias_score double, summary_score double, overlap double, shared long, jaccard double"
    rows = [(0, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 9, 1.0), (1, 1, 0.2, 0.0, 0.0, 0.0, 0.0, 0, 0.0), (1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 3, 0.25), (0, 0, 0.0, 0.0, 0.0, 0.72, 0.0, 0, 0.0), (0, 0, 0.1, 0.0, 0.0, 0.0, 0.5, 0, 0.0), (0, 0, 0.1, 0.9, 0.0, 0.0, 0.4, 3, 0.9)]
    assert [r["accepted"] for r in families.accepts(spark.createDataFrame(rows, cols)).collect()] == [False, True, True, True, True, False]


def slow_choice(nodes, limit, per, least, high):
    """Representatives by plain loops."""
    order = sorted(nodes, key=lambda n: (-n[2], n[0]))
    chosen = [n[0] for n in nodes if n[1] in ("authored", "mixed")]
    for n in order:
        if n[2] >= high and len(chosen) < limit and n[0] not in chosen:
            chosen.append(n[0])
    docs = {}
    for n in order:
        for d in n[3]:
            docs.setdefault(d, []).append(n)
    good = sorted((d for d in docs.items() if len(d[1]) >= least), key=lambda d: (-d[1][0][2], d[0]))
    turn, new = 0, True
    while len(chosen) < limit and (turn < per or new):
        new = False
        for _, items in good:
            if len(chosen) < limit and turn < len(items) and items[turn][0] not in chosen:
                chosen.append(items[turn][0])
                new = True
        turn += 1
    for n in order:
        if len(chosen) < limit and n[0] not in chosen:
            chosen.append(n[0])
    return set(chosen)


def test_representatives_equal_plain_loops(spark):
    for seed in range(4):
        r = random.Random(seed)
        nodes = [(f"n{k:03d}", r.choice(["conversation"] * 9 + ["authored"]), round(r.uniform(0, 75), 1), sorted({f"d{min(r.randrange(12), r.randrange(12))}" for _ in range(r.randint(1, 2))})) for k in range(120)]
        df = spark.createDataFrame(nodes, "node_id string, authority string, salience double, document_ids array<string>")
        got = {x["node_id"] for x in salience.representatives(df, 50).collect()}
        assert got == slow_choice(nodes, 50, 2, 3, 70.0) and len(got) == 50
    with pytest.raises(ValueError, match="limit"):
        salience.representatives(df, 1)


def test_title_disambiguation(spark):
    rows = [("n1", "Idea", ["Idea", "the long idea"], 3, 1), ("n2", "idea", ["second good idea", "the long idea"], 2, 1), ("n3", "IDEA!", ["the long idea"], 1, 1), ("n4", "Else", [], 1, 1)]
    got = {r["node_id"]: (r["title"], r["renamed"]) for r in families.distinct_titles(spark.createDataFrame(rows, "node_id string, title string, aliases array<string>, n_documents long, n_claims long")).collect()}
    assert got == {"n1": ("Idea", False), "n2": ("the long idea", True), "n3": ("IDEA!", False)}


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "segment_id string, text_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "segment_id string, text_hash string")
    assert {(r[0], r[1]) for r in incremental.diff(old, new).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")}
    assert {tuple(r) for r in incremental.upsert(old, new, "segment_id").collect()} == {("a", "1"), ("b", "9"), ("c", "3"), ("d", "4")}
    h = [incremental.table_hash(x, "segment_id", "text_hash").first()["hash"] for x in (old, old.orderBy(F.desc("segment_id")), new)]
    assert h[0] == h[1] != h[2]
    fam = lambda xs: spark.createDataFrame(xs, "family_id string, representative_hash string, synthesis_hash string")
    edges = spark.createDataFrame([("A", "B")], "src string, dst string")
    scope = incremental.affected(fam([("A", "1", "1"), ("B", "1", "1"), ("C", "1", "1")]), fam([("A", "1", "2"), ("B", "1", "1"), ("C", "1", "1")]), edges)
    assert {(r["family_id"], r["state"], r["in_review"]) for r in scope.collect()} == {("A", "changed", True), ("B", "reused", True), ("C", "reused", False)}
    assert incremental.scope_decision(scope).first()["fallback"] == "none"
    versions = spark.createDataFrame([("x", 1), ("y", 7), ("z", 9)], "cache_key string, version int")
    assert sorted(r[0] for r in incremental.current_version(versions, (1,), 7).collect()) == ["x", "y"]
    before = spark.createDataFrame([("F1", "n1"), ("F1", "n2"), ("F2", "n3")], "family_id string, node_id string")
    after = spark.createDataFrame([("G1", "n1"), ("G1", "n2"), ("G2", "n3"), ("G2", "n4")], "family_id string, node_id string")
    assert {(r["new_id"], r["family_id"]) for r in incremental.keep_ids(before, after).collect()} == {("G1", "F1"), ("G2", "F2")}
    assert incremental.same_run(versions.where("cache_key = 'x'"), version=1) and not incremental.same_run(versions.where("false"), version=1)


def test_audits(spark):
    want = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "batch_id int, ord int, input_id string")
    assert audit.batch_order(want, want).count() == 0 and audit.batch_order(want, want.where("ord = 0")).count() == 1
    stages = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("u", 1, "a"), ("v", 1, "a"), ("v", 2, "zz")], "trajectory_id string, stage int, node_id string")
    members = spark.createDataFrame([("g", "a", "core"), ("g", "b", None), ("g", "c", "x")], "group_id string, node_id string, role string")
    assert sorted(r[0] for r in audit.trajectories(stages, members).collect()) == ["u", "v"]
    assert [tuple(r) for r in audit.roles_partition(members).collect()] == [("g", "b")]
    rows = spark.createDataFrame([("d", 300, 1)] * 3 + [("e", 300, 2)] * 3 + [("f", 10, 0)] * 3, "document_id string, n_chars int, n_candidates int")
    assert {r["document_id"]: r["passes"] for r in audit.density(rows, ["document_id"]).collect()} == {"d": False, "e": True}
    assert audit.hub_threshold(100) == 12 and audit.hub_threshold(1001) == 21 and salience.size_cap(2955) == 900 and salience.size_cap(9927) == 2482
    report = spark.createDataFrame([(0.5, 0), (0.95, 0), (1.0, 2)], "share double, errors int")
    assert [r["level"] for r in audit.attention(report).collect()] == ["watch", "ok", "problem"]


def test_streams_equal_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, f in (("sessions", S.sessions), ("tumbling", S.tumbling)):
        d = str(tmp_path / name)
        src.write.parquet(d)
        stream = f(spark.readStream.schema(src.schema).parquet(d))
        q = stream.writeStream.outputMode("append" if name == "sessions" else "complete").format("memory").queryName(name).option("checkpointLocation", d + "-c").trigger(availableNow=True).start()
        q.awaitTermination()
        got, want = {tuple(r)[:3] for r in spark.table(name).collect()}, {tuple(r)[:3] for r in f(src).collect()}
        assert got and got <= want and (name == "sessions" or got == want)
    d, out = str(tmp_path / "up"), str(tmp_path / "sink")
    src.limit(50).write.parquet(d)
    q = spark.readStream.schema(src.schema).parquet(d).writeStream.foreachBatch(S.upsert_sink(out, "event_id")).option("checkpointLocation", d + "-c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{out}/v0").count() == 50
