"""From segments to a graph: offline candidates, identity resolution, claims, states, nodes and edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..plans.storage import cut, scratch
from .graph import connected

KEPT = 3
#: Relations that the offline provider draws between neighbouring claims, by the sum of their lengths.
DRAWN = ("supports", "revises", "supersedes", "tensions_with", "context_split", "semantic_related")


def candidates(segments: DataFrame, key_tokens: int = 2, kept: int = KEPT) -> DataFrame:
    """The offline provider: the first ``kept`` sentences of a segment that have two label tokens.

    key: slug of the first ``key_tokens`` tokens; type: question or thesis by its last mark; target: the next candidate's key, related by a
    type drawn from the two lengths; summary: the claim and the next one. A model may stand in for this with the same columns.
    """
    # tokens are made once a sentence and travel with it
    sentences = F.transform(F.split("text", r"(?<=[.?!])\s+"), lambda s: F.struct(T.js_trim(s).alias("claim"), T.tokens(s).alias("tok")))
    chosen = segments.select("segment_id", "document_id", "source_kind", "sequence_index", "time_unix", F.slice(F.filter(sentences, lambda s: F.size(s["tok"]) >= 2), 1, kept).alias("ss"))
    # the next sentence is beside its own in the segment's row, so nothing is shuffled for it
    pairs = F.transform("ss", lambda s, i: F.struct(s.alias("s"), F.get(F.col("ss"), i + 1).alias("then")))
    rows = chosen.select("segment_id", "document_id", "source_kind", "sequence_index", "time_unix", F.posexplode(pairs).alias("ord", "p"))
    key = lambda c: F.array_join(F.slice(c, 1, key_tokens), "-")
    claim, later, own, target = F.col("p.s.claim"), F.col("p.then.claim"), key(F.col("p.s.tok")), key(F.col("p.then.tok"))
    kind = F.element_at(F.array(*map(F.lit, DRAWN)), ((F.length(claim) + F.length(later)) % 6 + 1).cast("int"))
    return rows.select(
        "segment_id", "document_id", "source_kind", "sequence_index", "time_unix", F.col("ord").cast("long").alias("ord"), claim.alias("claim"), own.alias("canonical_key"), F.when(claim.endswith("?"), "question").otherwise("thesis").alias("node_type"), F.when(F.length(claim) % 5 == 0, "tentative").otherwise("active").alias("status"),
        F.when(target != own, target).alias("target_key"), F.when(target != own, kind).alias("relation"), F.concat_ws(":", "segment_id", F.col("ord").cast("string")).alias("candidate_id"), F.concat_ws(" ", claim, later).alias("summary"),
    )


def mergeable_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, reason) of candidates (id, key, title, summary, claim, node_type) that may be one identity: by equal key, or inside a block of type and title signature."""
    feats = rows.select("id", "key", "node_type", T.tokens(F.col("title")).alias("tt"), T.tokens(F.col("summary")).alias("st"), T.tokens(F.col("claim")).alias("ct"), T.tokens(F.col("key")).alias("kt"), T.signature(F.col("title"), F.col("key")).alias("sig"))
    side = lambda n: feats.select(*(F.col(c).alias(c + n) for c in feats.columns))
    x, y = side("1"), side("2")
    block = x.join(y, (F.col("node_type1") == F.col("node_type2")) & (F.col("sig1") == F.col("sig2")) & (F.col("key1") != F.col("key2")) & (F.col("id1") < F.col("id2"))).where("sig1 <> ''")
    j = lambda c: T.jaccard(F.col(c + "1"), F.col(c + "2"))
    close = (j("tt") >= 0.8) | (j("kt") >= 0.8) | (((j("tt") >= 0.5) | (j("kt") >= 0.5)) & ((j("st") >= 0.35) | (j("ct") >= 0.35)))
    return block.where(close).select(F.col("id1").alias("a"), F.col("id2").alias("b"), "key1", "key2")


def greedy_unions(ids: list, pairs: list[tuple], vetoes: set[tuple]) -> dict:
    """Unions in the order of ``pairs``, each skipped if a veto stands between the two groups as they are by then."""
    root = {i: i for i in ids}
    members = {i: {i} for i in ids}
    against: dict = {}
    for a, b in vetoes:
        against.setdefault(a, set()).add(b)
        against.setdefault(b, set()).add(a)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        if x == y:
            continue
        small, large = sorted((members[x], members[y]), key=len)
        if any(against.get(i, set()) & large for i in small):
            continue
        keep, gone = min(x, y), max(x, y)
        root[gone] = keep
        members[keep] |= members.pop(gone)
    return {i: find(i) for i in ids}


def sweep_unions(ids: list, pairs: list[tuple], vetoes: set[tuple]) -> dict:
    """Sweeps over all i < j until nothing changes: their groups unite if any accepted pair joins them and no veto stands between them."""
    group = {i: i for i in ids}
    members, near, against = {i: [i] for i in ids}, {i: set() for i in ids}, {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for a, b in vetoes:
        if a != b and a in group and b in group:
            against[a].add(b)
            against[b].add(a)
    changed = True
    while changed:
        changed = False
        for i in ids:
            at = i
            while True:  # the next j after the place reached whose group is joined to i's
                g = group[i]
                after = [(min(m for m in members[h] if m > at), h) for h in near[g] - against[g] if members[h][-1] > at]
                if not after:
                    break
                at, h = min(after)
                changed = True
                for m in members[h]:
                    group[m] = g
                members[g] = sorted(members[g] + members.pop(h))
                for links in (near, against):
                    for x in links.pop(h):
                        links[x].discard(h)
                        if x != g:
                            links[x].add(g)
                            links[g].add(x)
                    links[g].discard(h)
    return {i: members[group[i]][0] for i in ids}


def resolve(keys: DataFrame, pairs: DataFrame, vetoes: DataFrame, rule=greedy_unions) -> DataFrame:
    """``keys`` (key), candidate ``pairs`` (a, b) and ``vetoes`` (a, b) over keys -> (key, root).

    A union or veto only concerns groups that candidate pairs connect, so components of the pairs are resolved apart, each by the
    sequential ``rule`` in order of (a, b). Components are as large as their texts are alike, not as the corpus.
    """
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    comps = connected(pairs, "a", "b")
    p = pairs.join(comps, F.col("a") == F.col("node")).select("root", "a", "b", F.lit(True).alias("pair"))
    other = comps.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
    v = vetoes.join(comps, F.col("a") == F.col("node")).join(other, F.col("b") == F.col("n2")).where("root = r2").select("root", "a", "b", F.lit(False).alias("pair"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_pair = pdf["pair"].to_numpy(bool)
        ps = sorted(zip(pdf["a"][is_pair], pdf["b"][is_pair], strict=True))
        vs = set(zip(pdf["a"][~is_pair], pdf["b"][~is_pair], strict=True))
        got = rule(sorted({x for ab in ps for x in ab}), ps, vs)
        return pd.DataFrame({"key": list(got), "root": list(got.values())})

    found = p.unionByName(v.distinct()).groupBy("root").applyInPandas(run, "key string, root string")
    return keys.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def best_value(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The most frequent value of a group; of equally frequent ones the first seen."""
    per = df.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return per.groupBy(by).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "o", value)).alias(value))


def identities(nodes: DataFrame, cands: DataFrame) -> DataFrame:
    """(key, root) of every key of ``nodes``: one identity where a pair may be merged and no relation that a candidate draws stands between the groups."""
    rows = nodes.select(F.col("canonical_key").alias("id"), F.col("canonical_key").alias("key"), "title", "summary", F.col("title").alias("claim"), "node_type")
    vetoes = cands.where("target_key IS NOT NULL").select(F.col("canonical_key").alias("a"), F.col("target_key").alias("b")).distinct()
    return resolve(rows, mergeable_pairs(rows), vetoes)


def resolved(cands: DataFrame, roots: DataFrame) -> DataFrame:
    """``cands`` under their identities' keys: of a group's keys the one with most candidates, then the first candidate's. Targets follow; relations inside
    an identity go. ``alias`` keeps the key that a candidate came with."""
    keyed = cands.select("canonical_key", "candidate_id").join(roots, F.col("canonical_key") == F.col("key")).select("root", "canonical_key", "candidate_id")
    named = best_value(keyed, "root", "canonical_key", "candidate_id").withColumnRenamed("canonical_key", "best")
    to = cut(roots.join(named, "root").select("key", "best"), "identities")
    target = to.select(F.col("key").alias("target_key"), F.col("best").alias("target"))
    rows = cands.join(to, F.col("canonical_key") == F.col("key")).join(target, "target_key", "left")
    outside = F.coalesce("target", "target_key") != F.col("best")
    own = {"canonical_key": F.col("best"), "target_key": F.when(outside, F.coalesce("target", "target_key")), "relation": F.when(outside, F.col("relation"))}
    return rows.select(*(own.get(c, F.col(c)).alias(c) for c in cands.columns), F.col("canonical_key").alias("alias"))


def aliases(rows: DataFrame) -> DataFrame:
    """canonical_key, aliases: the sorted keys that ``resolved`` rows came with."""
    return rows.groupBy("canonical_key").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))


def claims(cands: DataFrame, timeline: DataFrame) -> DataFrame:
    """Candidates with their node's key, numbered within it in time order (time with nulls last, chronology, id)."""
    rows = cands.drop("time_unix").join(timeline.select("segment_id", "chronology_index", "time_unix"), "segment_id")
    w = Window.partitionBy("canonical_key").orderBy(F.col("time_unix").asc_nulls_last(), "chronology_index", "candidate_id")
    n = F.row_number().over(w)
    return rows.withColumn("claim_no", n.cast("long")).withColumn("claim_id", F.concat_ws(":", F.lit("claim"), "canonical_key", F.lpad(n.cast("string"), 4, "0")))


def states(claimed: DataFrame) -> DataFrame:
    """Each claim's state number: a new one where the status changes, or where claim and summary both differ from those before (Jaccard below .55 and .6)."""
    w = Window.partitionBy("canonical_key").orderBy("claim_no")
    t = claimed.withColumn("tok", T.tokens(F.col("claim"))).withColumn("stok", T.tokens(F.col("summary")))
    new = F.lag("claim_no").over(w).isNull() | (F.lag("status").over(w) != F.col("status")) | ((T.jaccard(F.lag("tok").over(w), F.col("tok")) < 0.55) & (T.jaccard(F.lag("stok").over(w), F.col("stok")) < 0.6))
    return t.withColumn("new", new.cast("long")).withColumn("state_no", F.sum("new").over(w)).drop("tok", "stok", "new")


def worldlines(stated: DataFrame) -> DataFrame:
    """States by node: first and last time, claims, what follows, and whether it was revised."""
    per = stated.groupBy("canonical_key", "state_no").agg(F.min("time_unix").alias("valid_from"), F.count("*").alias("n_claims"), F.min_by("status", "claim_no").alias("status"))
    w = Window.partitionBy("canonical_key").orderBy("state_no")
    return per.select("canonical_key", "state_no", F.concat_ws(":", F.lit("state"), "canonical_key", F.lpad(F.col("state_no").cast("string"), 4, "0")).alias("state_id"), "valid_from", F.lead("valid_from").over(w).alias("valid_until"), "n_claims", "status", F.when(F.col("state_no") == 1, "introduced").otherwise("revised").alias("transition"), F.lead("state_no").over(w).isNotNull().alias("invalidated"))


def nodes(claimed: DataFrame) -> DataFrame:
    """Claims rolled up by node: type and status by majority, evidence, kinds of source, first and last time."""
    kinds = [F.count_if(F.col("source_kind") == k).alias(f"n_{k}") for k in ("writing", "conversation", "chat")]
    base = claimed.groupBy("canonical_key").agg(F.count("*").alias("n_claims"), F.count_distinct("document_id").alias("n_documents"), F.min("time_unix").alias("first_seen"), F.max("time_unix").alias("last_seen"), F.min_by("claim", "claim_no").alias("title"), F.max_by("claim", "claim_no").alias("summary"), *kinds)
    for c in ("node_type", "status"):
        base = base.join(best_value(claimed, "canonical_key", c, "claim_no"), "canonical_key")
    return base.withColumn("node_id", F.concat(F.lit("thought:"), F.col("canonical_key")))


def nodes_of(cands: DataFrame) -> DataFrame:
    """``nodes`` of the candidates' claims, written, without numbering claims: a segment's rank in the chronology is the order of its time (nulls last), document,
    place and id, so the first and last claim of a key are found by these, and texts are shuffled once."""
    at = F.struct(F.col("time_unix").isNull().alias("undated"), "time_unix", "document_id", "sequence_index", "segment_id", "candidate_id")
    kinds = [F.count_if(F.col("source_kind") == k).alias(f"n_{k}") for k in ("writing", "conversation", "chat")]
    with scratch(cands.sparkSession) as keep:
        few = cands.select("canonical_key", "document_id", "source_kind", "node_type", "status", "time_unix", at.alias("at"))
        sums = few.groupBy("canonical_key").agg(F.count("*").alias("n_claims"), F.count_distinct("document_id").alias("n_documents"), F.min("time_unix").alias("first_seen"), F.max("time_unix").alias("last_seen"), *kinds)
        for c in ("node_type", "status"):
            sums = sums.join(best_value(few, "canonical_key", c, "at"), "canonical_key")
        sums = cut(sums, "node-sums")
        ends = cut(cands.groupBy("canonical_key").agg(F.min_by("claim", at).alias("title"), F.max_by("claim", at).alias("summary")), "node-texts")
        order = ["canonical_key", "n_claims", "n_documents", "first_seen", "last_seen", "title", "summary", *(f"n_{k}" for k in ("writing", "conversation", "chat")), "node_type", "status"]
        return keep(cut(sums.join(ends, "canonical_key").select(*order, F.concat(F.lit("thought:"), F.col("canonical_key")).alias("node_id")), "nodes"))


def edges(cands: DataFrame) -> DataFrame:
    """Drawn relations to keys that exist, and co-occurrence of keys in a segment; weight counts, segments are collected."""
    known = cands.select(F.col("canonical_key").alias("target_key")).distinct()
    drawn = cands.where("target_key IS NOT NULL").join(known, "target_key").select("segment_id", F.col("relation").alias("type"), F.col("canonical_key").alias("s"), F.col("target_key").alias("t"))
    keys = cands.select("segment_id", F.col("canonical_key").alias("s")).distinct()
    pairs = keys.join(keys.withColumnRenamed("s", "t"), "segment_id").where("s < t").select("segment_id", F.lit("co_occurs").alias("type"), "s", "t")
    symmetric = F.col("type").isin("co_occurs", "semantic_related", "tensions_with", "context_split")
    ends = lambda f, c: F.concat(F.lit("thought:"), F.when(symmetric, f("s", "t")).otherwise(F.col(c)))
    rows = drawn.unionByName(pairs).select("type", ends(F.least, "s").alias("src"), ends(F.greatest, "t").alias("dst"), "segment_id")
    return rows.groupBy("type", "src", "dst").agg(F.count("*").alias("weight"), F.array_sort(F.collect_set("segment_id")).alias("segments")).withColumn("edge_id", F.concat_ws(":", "type", "src", "dst"))
