"""The model seam: retries, repair one by one, error kinds."""

import pytest

from strandline.operators import maps, providers


def test_answers_in_order_and_repair():
    calls = []

    def shuffled(batch):
        calls.append(len(batch))
        return [{"id": x["id"], "y": 2 * x["id"]} for x in (reversed(batch) if len(batch) > 1 else batch)]

    got = providers.call(shuffled, [{"id": 1}, {"id": 2}, {"id": 3}], "id")
    assert [g["y"] for g in got] == [2, 4, 6] and calls == [3, 1, 1, 1]


def test_timeouts_are_tried_again_and_others_are_not():
    tries = []

    def slow(batch):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("timed out")
        return [{"id": x["id"]} for x in batch]

    assert providers.call(slow, [{"id": 1}], "id") == [{"id": 1}] and len(tries) == 2

    def refused(batch):
        tries.append(1)
        raise RuntimeError("401 unauthorized")

    with pytest.raises(providers.ProviderError) as e:
        providers.call(refused, [{"id": 1}], "id")
    assert e.value.kind == "auth" and len(tries) == 3
    with pytest.raises(providers.ProviderError):
        providers.call(lambda b: [{"id": "other"} for _ in b], [{"id": 1}], "id")
    assert [providers.failure_kind(m) for m in ("Rate limit hit", "read timeout", "boom")] == ["quota", "timeout", "other"]


def test_rows_through_a_provider(spark):
    def double(batch):
        return [{"id": x["id"], "y": 2 * x["id"]} for x in batch]

    rows = providers.through(spark.range(70), double, "id", "id long, y long", size=8).collect()
    assert sorted((r["id"], r["y"]) for r in rows) == [(k, 2 * k) for k in range(70)]


def test_dossiers_and_entry_points(spark):
    nodes = spark.createDataFrame([("n1", "Title", "Sum"), ("n2", "Bare", "S")], "node_id string, title string, summary string")
    quotes = spark.createDataFrame([("n1", 2, "second"), ("n1", 1, "first\nline")], "node_id string, rank int, text string")
    pages = {r["name"]: r["body"] for r in maps.dossiers(nodes, quotes).collect()}
    assert pages == {"n1": "## Title\n\nID: n1\n\nSum\n\n> first\n> line\n\n> second", "n2": "## Bare\n\nID: n2\n\nS"}
    groups = spark.createDataFrame([("g1", "core_direction", 1.0), ("g2", "other", 9.0), ("g3", "core_direction", 5.0)], "group_id string, role string, salience double")
    assert [r["group_id"] for r in maps.entry_points(groups, 1).collect()] == ["g3"]
    cases = maps.retrieval_cases(groups.selectExpr("group_id", "'t' AS title"), nodes.selectExpr("node_id", "title", "1.0 AS salience"), quotes.selectExpr("node_id", "text AS segment_id", "'d' AS document_id"))
    assert cases.count() == 3 + 2 + 2
