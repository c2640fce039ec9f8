"""Reviews: what they leave on disk, nodes made without numbering claims, and bounds that lose no pair."""

import os

from pyspark.sql import functions as F

from strandline.operators import corpus, families, resolve
from strandline.plans import graph as Q
from strandline.plans import registry, storage

from .test_brute_force import DATA, as_frames, made_up


def tables(spark):
    folder = storage.application_dir(spark).removeprefix("file:").replace("//", "/")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_review_candidates_leave_their_result_alone(spark):
    before = tables(spark)
    rows = registry.QUERIES["review_candidates"](spark, DATA)
    assert len(tables(spark) - before) == 1
    assert rows.count() == rows.select("a", "b").distinct().count() > 0


def test_scratch(spark):
    before, was = tables(spark), spark.conf.get(storage.TIDY)
    with storage.scratch(spark) as keep:
        with storage.scratch(spark) as own:
            a = storage.cut(spark.range(9), "a")
            b = own(storage.cut(a.groupBy((F.col("id") % 2).alias("k")).count(), "b"))
        assert {x[0] for x in tables(spark) - before} == {"b"}
        c = keep(storage.cut(b.where("k = 0"), "c"))
    assert {x[0] for x in tables(spark) - before} == {"c"} and c.collect()[0]["count"] == 5 and spark.conf.get(storage.TIDY) == was


def test_nodes_of_candidates(spark):
    c = Q._cands(spark, DATA)
    want, got = resolve.nodes(Q._claims(spark, DATA, c)), resolve.nodes_of(c)
    assert {r["node_id"]: r.asDict() for r in got.collect()} == {r["node_id"]: r.asDict() for r in want.collect()}
    # dated claims come before undated ones
    times = c.withColumn("time_unix", F.when(F.crc32("segment_id") % 3 > 0, F.crc32("segment_id") % 50))
    segments = times.select("segment_id", "document_id", "sequence_index", "time_unix").distinct()
    want, got = resolve.nodes(resolve.claims(times, corpus.timeline(segments))), resolve.nodes_of(times)
    assert {r["node_id"]: r.asDict() for r in got.collect()} == {r["node_id"]: r.asDict() for r in want.collect()}


def test_reviews_in_a_scope(spark):
    """Later passes review pairs with an end in the scope alone, and find of them what a review of all finds."""
    n, e, d = as_frames(spark, *made_up(2))
    scope = storage.cut(n.where("node_id < 't:012'").select("node_id"), "scope")
    ids = {r["node_id"] for r in scope.collect()}
    want = {tuple(r) for r in families.review_candidates(n, e, d).collect() if r["a"] in ids or r["b"] in ids}
    assert {tuple(r) for r in families.review_candidates(n, e, d, scope=scope).collect()} == want and want
