"""Queries and operators without SQL against plain loops."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import families, graph, resolve, salience
from strandline.plans import graph as Q
from strandline.plans import registry

from .test_operators import naive_sweep, slow_choice

DATA = "/root/testdata/sf0.001"
POSITIVE, REVISION, BLOCKING = ("semantic_related", "supports", "revises", "supersedes"), ("revises", "supersedes"), ("tensions_with", "context_split")
SYMMETRIC = ("co_occurs", "semantic_related", *BLOCKING)


@pytest.fixture(scope="module")
def small(spark):
    c, n, e = Q._graph(spark, DATA)
    return c, n, e


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def overlap(a, b):
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def tokens(x, stop=T.FAMILY_STOP):
    return [w for w in re.split("[^a-z0-9]+", x.lower()) if len(w) >= 3 and w not in stop]


def slow_pairs(edges):
    """(a, b) -> [semantic, revision, blocking, types, shared, jaccard], of pairs with an edge or two common positive neighbours."""
    near, out = {}, {}
    for e in edges:
        if e["src"] != e["dst"]:
            p = out.setdefault(tuple(sorted((e["src"], e["dst"]))), [0, 0, 0, set(), 0, 0.0])
            p[0] += e["weight"] * (e["type"] in ("semantic_related", "supports"))
            p[1] += e["weight"] * (e["type"] in REVISION)
            p[2] += e["weight"] * (e["type"] in BLOCKING)
            p[3].add(e["type"])
            if e["type"] in POSITIVE:
                near.setdefault(e["src"], set()).add(e["dst"])
                near.setdefault(e["dst"], set()).add(e["src"])
    for a, b in itertools.combinations(sorted(near), 2):
        x, y = near[a] - {b}, near[b] - {a}
        if near[a] & near[b] and ((a, b) in out or len(near[a] & near[b]) >= 2):
            p = out.setdefault((a, b), [0, 0, 0, set(), 0, 0.0])
            p[4], p[5] = len(x & y), len(x & y) / len(x | y)
    return out


def slow_reviews(nodes, edges, docs):
    """(a, b) -> (reason, accepted)."""
    pairs, by_id, found = slow_pairs(edges), {n["node_id"]: n for n in nodes}, {}
    for a, b in itertools.combinations(sorted(by_id), 2):
        x, y = by_id[a], by_id[b]
        sem, rev, blk, types, shared, jac = pairs.get((a, b), [0, 0, 0, set(), 0, 0.0])
        tt = lambda n: tokens(n["title"] + " " + n["summary"])
        dt, st, al, kt = (lambda n: tokens(n["title"])), (lambda n: tokens(n["summary"])), (lambda n: tokens(" ".join(n["aliases"]))), (lambda n: tokens(n["canonical_key"]))
        j = lambda f: jaccard(f(x), f(y))  # noqa: B023, E731
        slug = lambda n: "-".join(w for w in re.split("[^a-z0-9]+", n["title"].lower()) if w)
        num = lambda n: "|".join(re.findall(r"\d+", n["title"]))
        over, same_type = overlap(docs[a], docs[b]), x["node_type"] == y["node_type"]
        title, alias, key, summary, reason = j(tt), j(al), j(kt), j(st), None
        lex = max(title, alias, key) >= 0.18
        anchor = title >= 0.16 or alias >= 0.08
        if types:
            if rev and blk:
                reason = "revision_and_blocking_overlap"
            elif rev and lex:
                reason = "revision_family_review"
            elif not blk and sem >= 6 and (alias >= 0.08 or rev and lex or over >= 0.5 and title >= 0.16):
                reason = "strong_related_family_review"
            elif not blk and over >= 0.75 and sem and same_type and (title >= 0.18 or alias >= 0.12):
                reason = "same_source_family_review"
            elif not blk and sem and shared >= 3 and jac >= 0.35 and (rev and (over >= 0.5 or anchor) or over >= 0.5 and anchor):
                reason = "graph_neighborhood_family_review"
        if reason is None and not blk:
            title = j(dt)
            if set(docs[a]) & set(docs[b]) and len(dt(x)) >= 2 and len(dt(y)) >= 2 and set(dt(x)) & set(dt(y)):
                if slug(x) == slug(y):
                    reason = "duplicate_title_review"
                elif same_type and title >= 0.55 and not (num(x) and num(y) and num(x) != num(y)):
                    reason = "same_source_title_review"
            if reason is None and same_type and len(st(x)) >= 5 and len(st(y)) >= 5 and summary >= 0.72:
                reason = "duplicate_summary_review"
        if reason:
            if blk and not rev:
                ok = False
            elif rev:
                ok = title >= 0.18 or key >= 0.18 or shared >= 3 and jac >= 0.25
            else:
                ok = summary >= 0.72 or (title >= 0.1 or alias >= 0.1) and (over >= 0.5 or shared >= 4 and jac >= 0.35)
            found[a, b] = (reason, ok)
    return found


def slow_refine(nodes, edges, docs):
    """node_id -> family id, by reviews and merges until none is accepted."""
    to, nodes, docs = {n["node_id"]: n["node_id"] for n in nodes}, [dict(n) for n in nodes], {k: set(v) for k, v in docs.items()}
    while True:
        accepted = [p for p, (_, ok) in slow_reviews(nodes, edges, {k: sorted(v) for k, v in docs.items()}).items() if ok]
        if not accepted:
            return to
        root = {n["node_id"]: n["node_id"] for n in nodes}
        for a, b in accepted:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
        now, merged = {}, []
        for r in sorted(set(root.values())):
            group = sorted((n for n in nodes if root[n["node_id"]] == r), key=lambda n: n["node_id"])
            best = min(group, key=lambda n: (-n["n_claims"], -n["n_documents"], n["node_id"]))
            ids = [n["node_id"] for n in group]
            new = r if len(ids) == 1 else f"consolidated:{hashlib.sha256(chr(10).join(ids).encode()).hexdigest()[:12]}:{best['canonical_key']}"
            now |= dict.fromkeys(ids, new)
            united = set().union(*(docs[i] for i in ids))
            merged.append(group[0] | {"node_id": new, "canonical_key": best["canonical_key"], "aliases": sorted({x for n in group for x in n["aliases"]}), "n_claims": sum(n["n_claims"] for n in group), "n_documents": len(united), "first_seen": min(n["first_seen"] for n in group), "last_seen": max(n["last_seen"] for n in group), "docs": united})
        to, sums = {k: now[v] for k, v in to.items()}, {}
        for e in edges:
            a, b = now[e["src"]], now[e["dst"]]
            if a != b:
                a, b = sorted((a, b)) if e["type"] in SYMMETRIC else (a, b)
                sums[e["type"], a, b] = sums.get((e["type"], a, b), 0) + e["weight"]
        nodes, docs = merged, {n["node_id"]: n["docs"] for n in merged}
        seen = {n["node_id"]: (n["last_seen"], n["first_seen"]) for n in nodes}
        rank = lambda k: (*seen[k[1]], sums[k], ":".join(k))  # noqa: B023, E731
        lost = {k for k in sums if k[0] in REVISION and (k[0], k[2], k[1]) in sums and rank(k) < rank((k[0], k[2], k[1]))}
        edges = [{"type": t, "src": a, "dst": b, "weight": w} for (t, a, b), w in sums.items() if (t, a, b) not in lost]


def made_up(seed, n=40):
    """Nodes that share words, edges of all types and documents."""
    r = random.Random(seed)
    words = "river stone cloud ember field harbor island lantern meadow north orchard pebble quarry ridge summit timber valley willow".split()
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    nodes = [{"node_id": f"t:{k:03d}", "node_type": r.choice(["thesis", "question"]), "canonical_key": "-".join(r.sample(words, 2)), "title": text(r.randint(2, 4)) + r.choice(["", "", " 1", " 2"]), "summary": text(r.randint(3, 8)), "status": "active", "n_claims": r.randint(1, 5), "n_documents": 1, "first_seen": r.randint(0, 50), "last_seen": r.randint(50, 90)} for k in range(n)]
    for k in range(0, n - 1, 6):  # some say the same
        nodes[k + 1] |= {"title": nodes[k]["title"], "summary": nodes[k]["summary"], "node_type": nodes[k]["node_type"]}
    for x in nodes:
        x["aliases"] = [x["title"]]
    docs = {x["node_id"]: sorted({f"d{r.randrange(8)}" for _ in range(r.randint(1, 2))}) for x in nodes}
    kinds, edges = [*POSITIVE, *POSITIVE, *BLOCKING, "co_occurs"], {}
    for _ in range(6 * n):
        at = r.randrange(n - 6)
        a, b, t = *r.sample([x["node_id"] for x in nodes[at : at + 6]], 2), r.choice(kinds)
        a, b = sorted((a, b)) if t in SYMMETRIC else (a, b)
        edges[t, a, b] = r.randint(1, 6)
    return nodes, [{"edge_id": f"{t}:{a}:{b}", "type": t, "src": a, "dst": b, "weight": w, "segments": ["s"]} for (t, a, b), w in edges.items()], docs


def as_frames(spark, nodes, edges, docs):
    n = spark.createDataFrame([tuple(x[c] for c in ("node_id", "node_type", "canonical_key", "title", "summary", "status", "n_claims", "n_documents", "first_seen", "last_seen", "aliases")) for x in nodes], "node_id string, node_type string, canonical_key string, title string, summary string, status string, n_claims long, n_documents long, first_seen long, last_seen long, aliases array<string>")
    e = spark.createDataFrame([tuple(x[c] for c in ("edge_id", "type", "src", "dst", "weight", "segments")) for x in edges], "edge_id string, type string, src string, dst string, weight long, segments array<string>")
    return n, e, spark.createDataFrame([(k, d) for k, ds in docs.items() for d in ds], "node_id string, document_id string")


def test_review_candidates(spark):
    reasons = set()
    for seed in (1, 2, 4):
        nodes, edges, docs = made_up(seed)
        rows = families.accepts(families.review_candidates(*as_frames(spark, nodes, edges, docs))).collect()
        want = slow_reviews(nodes, edges, docs)
        assert {(r["a"], r["b"]): (r["reason"], r["accepted"]) for r in rows} == want and len(rows) == len(want)
        reasons |= {x for x, _ in want.values()}
    assert len(reasons) >= 6


def test_refined_graph(spark):
    nodes, edges, docs = made_up(3, 30)
    want = slow_refine(nodes, edges, docs)
    n, e, to = families.refine(*as_frames(spark, nodes, edges, docs), passes=12)
    assert {r["node_id"]: r["family_id"] for r in to.collect()} == want and 1 < len(set(want.values())) < len(nodes)
    assert {r["node_id"] for r in n.select("node_id").collect()} == set(want.values()) and e.where("src = dst").isEmpty()
    with pytest.raises(ValueError, match="passes"):
        families.refine(*as_frames(spark, nodes, edges, docs), passes=0)


def test_identities(spark, small):
    """Identity blocks: all pairs inside equal signatures, united in order under the vetoes of drawn relations."""
    c, n, _ = small
    tok = lambda x: T.tokens(F.col(x))
    rows = n.select("canonical_key", "node_type", tok("title").alias("tt"), tok("summary").alias("st"), T.tokens(F.col("canonical_key")).alias("kt"), T.signature(F.col("title"), F.col("canonical_key")).alias("sig")).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault((r["node_type"], r["sig"]), []).append(r)
    pairs = []
    for (_, sig), group in blocks.items():
        for x, y in itertools.combinations(sorted(group, key=lambda r: r["canonical_key"]), 2):
            t, k, s = jaccard(x["tt"], y["tt"]), jaccard(x["kt"], y["kt"]), jaccard(x["st"], y["st"])
            if sig and (t >= 0.8 or k >= 0.8 or (t >= 0.5 or k >= 0.5) and (s >= 0.35 or t >= 0.35)):
                pairs.append((x["canonical_key"], y["canonical_key"]))
    vetoes = {(r[0], r[1]) for r in c.where("target_key IS NOT NULL").select("canonical_key", "target_key").collect()}
    want = resolve.greedy_unions(sorted(r["canonical_key"] for r in rows), sorted(pairs), vetoes)
    assert {r["key"]: r["root"] for r in registry.QUERIES["identity_blocks"](spark, DATA).collect()} == want

    cands = c.select("canonical_key", "candidate_id", "target_key", "segment_id", "document_id").collect()
    groups, best = {}, {}
    for r in cands:
        groups.setdefault(want[r["canonical_key"]], {}).setdefault(r["canonical_key"], []).append(r["candidate_id"])
    for root, keys in groups.items():
        best[root] = min(keys, key=lambda k: (-len(keys[k]), min(keys[k]), k))
    final = {k: best[want[k]] for k in want}
    assert {r["key"]: r["canonical_key"] for r in registry.QUERIES["alias_keys"](spark, DATA).collect()} == {r["canonical_key"]: final[r["canonical_key"]] for r in cands}
    got = {r["node_id"]: r for r in registry.QUERIES["resolved_nodes"](spark, DATA).collect()}
    claims, used = {}, {}
    for r in cands:
        claims.setdefault("thought:" + final[r["canonical_key"]], []).append(r["document_id"])
        used.setdefault("thought:" + final[r["canonical_key"]], set()).add(r["canonical_key"])
    assert {k: (v["n_claims"], v["n_documents"], v["aliases_md5"]) for k, v in got.items()} == {k: (len(v), len(set(v)), hashlib.md5("\n".join(sorted(used[k])).encode()).hexdigest()) for k, v in claims.items()}
    together = {}
    for r in cands:
        together.setdefault(r["segment_id"], set()).add(final[r["canonical_key"]])
    weights = {}
    for keys in together.values():
        for a, b in itertools.combinations(sorted(keys), 2):
            weights["thought:" + a, "thought:" + b] = weights.get(("thought:" + a, "thought:" + b), 0) + 1
    edges = registry.QUERIES["resolved_edges"](spark, DATA).collect()
    assert {(r["src"], r["dst"]): r["weight"] for r in edges if r["type"] == "co_occurs"} == weights and all(r["src"] != r["dst"] for r in edges)


def test_family_clusters_and_families(spark, small):
    _, n, e = small
    pairs = {(r["a"], r["b"]) for r in registry.QUERIES["family_pairs"](spark, DATA).collect()}
    vetoes = {(r["src"], r["dst"]) for r in e.where(F.col("type").isin(*BLOCKING)).collect()}
    ids = sorted({x for p in pairs for x in p})
    want = naive_sweep(ids, pairs, {v for v in vetoes if v[0] != v[1]})
    got = {r["node_id"]: r["root"] for r in registry.QUERIES["family_clusters"](spark, DATA).collect()}
    assert got == {r["node_id"]: want.get(r["node_id"], r["node_id"]) for r in n.select("node_id").collect()}
    groups = {}
    for r in n.collect():
        groups.setdefault(got[r["node_id"]], []).append(r)
    rows = {}
    for group in groups.values():
        group.sort(key=lambda r: r["node_id"])
        best = min(group, key=lambda r: (-r["n_claims"], -r["n_documents"], r["node_id"]))
        name = f"consolidated:{hashlib.sha256(chr(10).join(r['node_id'] for r in group).encode()).hexdigest()[:12]}:{best['canonical_key']}"
        seen = lambda c, f: f([r[c] for r in group if r[c] is not None], default=None)  # noqa: B023, E731
        rows[name] = (best["canonical_key"], group[0]["node_type"], group[0]["status"], len(group), sum(r["n_claims"] for r in group), seen("first_seen", min), seen("last_seen", max))
    assert {r["family_id"]: tuple(r)[1:] for r in registry.QUERIES["consolidated_families"](spark, DATA).collect()} == rows


def test_representatives_query(spark, small):
    a = Q._assessed(spark, DATA).collect()
    limit = max(salience.size_cap(len(a)), sum(r["authority"] in ("authored", "mixed") for r in a))
    got = registry.QUERIES["representatives"](spark, DATA).collect()
    assert {r["node_id"] for r in got} == slow_choice([(r["node_id"], r["authority"], r["salience"], r["document_ids"]) for r in a], limit, 2, 3, 70.0)


def test_distinct_titles_query(spark, small):
    c, n, _ = small
    alias = {}
    for r in c.select("canonical_key", "claim").collect():
        alias.setdefault("thought:" + r["canonical_key"], set()).add(r["claim"])
    first = n.select("node_id", F.substring_index("title", " ", 1).alias("title"), T.slugify(F.substring_index("title", " ", 1)).alias("slug"), (1000 * F.col("n_documents") + 10 * F.col("n_claims")).alias("score")).collect()
    slugs = {r[0]: r[1] for r in c.select("claim", T.slugify(F.col("claim"))).distinct().collect()}
    groups, want = {}, {}
    for r in first:
        groups.setdefault(r["slug"], []).append(r)
    for slug, group in groups.items():
        used = {slug}
        for k, r in enumerate(sorted(group, key=lambda r: (-r["score"], r["node_id"])) if len(group) > 1 else []):
            fit = sorted((len(x), x) for x in alias[r["node_id"]] if len(x) <= 90 and 2 <= len(x.split()) <= 10)
            pick = next((x for _, x in fit if slugs[x] not in used), None) if k else None
            if pick is not None:
                used.add(slugs[pick])
            want[r["node_id"]] = (pick if pick is not None else r["title"], pick is not None)
    assert {r["node_id"]: (r["title"], r["renamed"]) for r in registry.QUERIES["distinct_titles"](spark, DATA).collect()} == want
