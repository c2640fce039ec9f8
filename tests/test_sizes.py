"""Queries on what the driver's smallest tables do not have: odd characters, long titles, nodes with very many claims, large groups."""

import itertools
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import families, frames, graph, maps, similarity
from strandline.plans import registry

from .test_brute_force import as_frames, made_up
from .test_queries import plain


def equals_sql(spark, folder, name, **tables):
    """The query on ``tables`` alone, and its SQL."""
    duck = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = registry.QUERIES[name](spark, str(folder)).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    return got


def test_summary_score_of_odd_titles(spark, tmp_path):
    titles = ["\u00dfheit, | und", "\ufb01n", "\u0149 x", "\u1fb3 b", "\u1f88 c", "\u01c6 d", "\u00e9t\u00e9", "a" * 100_050 + "?", "?", "\U00010428 e"]
    docs = spark.createDataFrame(list(enumerate(titles)), "doc_id long, text string")
    assert len(equals_sql(spark, tmp_path, "summary_score", documents=docs)) == len(titles)


def test_capitals_are_those_of_sql(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(c, chr(c)) for c in codes if c < 0x2FFFF and chr(c) != chr(c).upper()], "c long, x string").select("c", T.capitalize(F.col("x")))
    want = dict(duckdb.execute("SELECT c, upper(chr(c::INT)) FROM unnest(?) t(c)", [codes]).fetchall())
    assert [(c, up, want[c]) for c, up in got.collect() if up != want[c]] == []


def test_latest_claims_of_a_node_with_ten_thousand(spark):
    """Ids of four digits repeat: claim 1000 has that of claim 10000, which is current."""
    n = F.col("id") + 1
    claims = spark.range(10_020).select(F.lit("k").alias("canonical_key"), n.alias("claim_no"), F.concat(F.lit("claim:k:"), F.lpad(n.cast("string"), 4, "0")).alias("claim_id"), F.lit(None).cast("long").alias("time_unix"), (20_000 - n).alias("chronology_index"))
    got = maps.latest_claims(claims, claims.where("claim_no >= 10000")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("k", "claim:k:1000", k, 1) for k in (1, 2, 3)]
    got = maps.latest_claims(claims, claims.where("claim_no IN (10000, 10019)")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("k", "claim:k:1000", 1, 1), ("k", "claim:k:1001", 2, 1), ("k", "claim:k:0001", 3, 0)]


def test_few_pairs_leave_the_join_of_prefixes(spark):
    """Of sets over a small vocabulary nearly all pairs share a token of their prefixes, and few are near."""
    r = random.Random(4)
    sets = [set(r.sample(range(60), r.randint(6, 12))) for _ in range(300)]
    sets += [s ^ {r.randrange(60)} for s in sets[:40]]
    near = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if len(a & b) / len(a | b) >= 0.72}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "rid long, s array<long>").select("rid", F.transform("s", lambda t: F.xxhash64(t)).alias("h"))
    got = {tuple(x) for x in similarity.near_sets(similarity.heads(rows, 0.72), 0.72).collect()}
    assert near <= got and len(got) <= 2 * len(near)


def frame_rows(spark, r, n):
    """Frames over few nodes, one in nearly all; some frames are the same in several documents, some have no anchors."""
    rows = []
    for i in range(n):
        q = random.Random(i % 9) if i % 3 == 0 else r
        nodes = {f"n{q.randrange(12)}" for _ in range(q.randint(0, 4))} | {"hub"}
        anchors = None if q.random() < 0.1 else [f"word{q.randrange(9)}" for _ in range(q.randint(1, 5))]
        rows.append((f"f{i:03d}", f"d{i // 2}", " ".join(f"word{q.randrange(14)}" for _ in range(q.randint(0, 6))), anchors, [(x, q.random() < 0.5) for x in sorted(nodes)]))
    f = spark.createDataFrame([x[:4] for x in rows], "frame_id string, document_id string, label string, anchors array<string>")
    return rows, f, spark.createDataFrame([(x[0], *m) for x in rows for m in x[4]], "frame_id string, node_id string, anchor boolean")


def test_frame_pairs_lose_nothing(spark):
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    rows, f, m = frame_rows(spark, random.Random(5), 120)
    want = set()
    for x, y in itertools.combinations(rows, 2):
        a, b = dict(x[4]), dict(y[4])
        shared = set(a) & set(b)
        one = x[3] and y[3] and any(a[k] and b[k] for k in shared) and jaccard(set(x[3]), set(y[3])) >= 0.14
        two = len(shared) >= 2 and jaccard({t for t in x[2].split() if t}, {t for t in y[2].split() if t}) >= 0.16
        if x[1] != y[1] and len(shared) / min(len(a), len(b)) >= 0.5 and (one or two):
            want.add((x[0], y[0], len(shared)))
    got = [tuple(p) for p in frames.frame_pairs(f, m).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 100


def test_frames_alike_meet_once(spark, monkeypatch):
    """Three hundred copies of one frame are one class: one pair of it is compared, and all of theirs come out."""
    f = spark.range(300).select(F.format_string("f%03d", "id").alias("frame_id"), F.col("id").cast("string").alias("document_id"), F.lit("same words here").alias("label"), F.array(F.lit("same"), F.lit("words")).alias("anchors"))
    written = {}
    monkeypatch.setattr(frames, "cut", lambda df, name, cut=frames.cut: written.setdefault(name, cut(df, name)))
    assert frames.frame_pairs(f, f.select("frame_id", F.lit("k").alias("node_id"), F.lit(True).alias("anchor"))).count() == 300 * 299 // 2
    assert written["class-pairs"].count() == 1


def test_families_need_no_pairs(spark, monkeypatch):
    """Families of classes are those of their frames' pairs, also of frames that are alike in one document, and no pair of copies is made for them."""
    _, f, m = frame_rows(spark, random.Random(6), 90)
    more = f.where("frame_id < 'f030'").selectExpr("concat('x', frame_id) AS frame_id", "document_id", "label", "anchors")
    f, m = f.unionByName(more), m.unionByName(m.where("frame_id < 'f030'").selectExpr("concat('x', frame_id) AS frame_id", "node_id", "anchor"))
    alone = spark.createDataFrame([(f"y{i}", "d999", "lonely words", ["lonely", "words"]) for i in range(3)] + [(f"z{i}", None, "same words", ["same"]) for i in range(2)], f.schema)
    f, m = f.unionByName(alone), m.unionByName(alone.selectExpr("frame_id", "'lonely' AS node_id", "true AS anchor"))
    want = sorted(map(tuple, frames.frame_families(f, frames.frame_pairs(f, m)).collect()))
    assert sorted(map(tuple, frames.aligned_families(f, m).collect())) == want and len(want) > 100
    copies = spark.range(2500).select(F.format_string("f%04d", "id").alias("frame_id"), F.col("id").cast("string").alias("document_id"), F.lit("same words here").alias("label"), F.array(F.lit("same"), F.lit("words")).alias("anchors"))
    nodes = copies.select("frame_id", F.lit("k").alias("node_id"), F.lit(True).alias("anchor"))
    written = {}
    monkeypatch.setattr(frames, "cut", lambda df, name, cut=frames.cut: written.setdefault(name, cut(df, name)))
    got = frames.aligned_families(copies, nodes).agg(F.count("*"), F.min("family"), F.max("family"), F.min("size"), F.max("cohesion")).first()
    assert tuple(got) == (2500, "f0000", "f0000", 2500, 2500 * 2499) and max(t.count() for t in written.values()) == 2500
    assert frames.frame_pairs(copies, nodes).selectExpr("count(distinct a, b)", "sum(int(a < b))").first() == (2500 * 2499 // 2,) * 2


def test_frames_that_share_a_hub_alone_do_not_leave_the_join(spark):
    """Frames of four nodes share one that all have: half of them would have to be shared."""
    f = spark.range(200).select(F.format_string("f%03d", "id").alias("frame_id"), F.col("id").cast("string").alias("document_id"), F.lit("same words here").alias("label"), F.array(F.lit("same"), F.lit("words")).alias("anchors"))
    m = f.select("frame_id", F.explode(F.array(F.lit("hub"), *(F.concat("frame_id", F.lit(x)) for x in "abc"))).alias("node_id")).withColumn("anchor", F.col("node_id") == "hub")
    sets, _ = frames._classes(f, m)
    assert sets.count() == 200 and frames._near_classes(sets).count() == 0


def test_wide_tables_are_not_sent_to_all_workers(spark):
    """Few rows, but 20 MB of words; the same rows with short words are light."""
    wide = spark.range(1000).select("id", F.array_repeat(F.repeat(F.lit("w"), 1000), 20).alias("s"))
    assert not similarity.is_light(wide) and not similarity.is_light(wide.select(F.array_join("s", "").alias("x")))
    assert similarity.is_light(wide.select("id", F.array(F.lit("w"), F.lit(None)).alias("s"))) and similarity.is_light(wide.where("id < 0"))
    assert "hint" not in similarity.light(wide)._jdf.queryExecution().analyzed().toString().lower()


def test_stars_come_in_parts(monkeypatch):
    """A worker gives its stars once it holds so many nodes, and what they link is what the edges link."""
    monkeypatch.setattr(graph, "HELD", 10)
    r, most = random.Random(7), []
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(60)]
    batches = (pd.DataFrame(edges[k : k + 5], columns=["a", "b"]) for k in range(0, 60, 5))
    got = [(a, b) for part in graph._stars(batches) for a, b in (most.append(len(part)) or part.itertuples(index=False))]
    assert max(most) < 20 and len(most) > 3

    def groups(pairs):
        root = {x: x for p in edges for x in p}
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert groups(got) == groups(edges)


def test_passes_that_merge_much_are_written(spark, monkeypatch):
    """What is read after a pass with a mapping that is not light is a table, without the joins of the pass; the outcome is the same."""
    inputs = as_frames(spark, *made_up(3, 30))
    accepted = families.accepts(families.review_candidates(*inputs)).where("accepted").select("a", "b")
    want = [sorted(map(str, t.collect())) for t in families.apply_reviews(*inputs, accepted)]
    monkeypatch.setattr(similarity, "LIGHT_BYTES", 0)
    got = families.apply_reviews(*inputs, accepted)
    assert [sorted(map(str, t.collect())) for t in got] == want
    assert all("Join" not in t._jdf.queryExecution().optimizedPlan().toString() for t in got[:3])
