"""Incremental recomputation: content hashes, diffs, cache lookups, affected scope and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

SHARE, COUNT = 0.35, 60


def segment_index(segments: DataFrame, contract: str = "v1") -> DataFrame:
    """segment_id with hashes of the text, its context, and the cache key under a contract."""
    w = Window.partitionBy("document_id").orderBy("sequence_index")
    context = F.concat_ws("\x1f", F.coalesce(F.lag("text").over(w), F.lit("")), F.coalesce(F.lead("text").over(w), F.lit("")))
    rows = segments.select("segment_id", "document_id", F.sha2("text", 256).alias("text_hash"), F.sha2(context, 256).alias("context_hash"))
    return rows.withColumn("cache_key", F.sha2(F.concat_ws("|", F.lit(contract), "text_hash", "context_hash"), 256))


def diff(previous: DataFrame, current: DataFrame, id_col: str = "segment_id", hash_col: str = "text_hash") -> DataFrame:
    """(id, change): added, removed, changed or unchanged, by a full outer join on the id."""
    p = previous.select(F.col(id_col), F.col(hash_col).alias("was"))
    c = current.select(F.col(id_col), F.col(hash_col).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return p.join(c, id_col, "full_outer").select(id_col, change.alias("change"))


def resolve_cache(items: DataFrame, cache: DataFrame, policy: str = "mixed") -> DataFrame:
    """``segment_id, cache_key, active_key`` with the entry to use: the exact key's, or under ``mixed`` first the previously active key's if its text hash still fits."""
    c = cache.select(F.col("cache_key").alias("k"), F.col("text_hash").alias("h"), F.col("contract").alias("contract"))
    exact = items.join(c.select(F.col("k").alias("cache_key"), F.col("contract").alias("exact_contract")), "cache_key", "left")
    if policy == "strict":
        return exact.select("segment_id", F.when(F.col("exact_contract").isNotNull(), F.col("cache_key")).alias("entry"))
    before = exact.join(c.select(F.col("k").alias("active_key"), F.col("h").alias("active_hash")), "active_key", "left")
    keep = F.when(F.col("active_hash") == F.col("text_hash"), F.col("active_key"))
    return before.select("segment_id", F.coalesce(keep, F.when(F.col("exact_contract").isNotNull(), F.col("cache_key"))).alias("entry"))


def pending(items: DataFrame, cache: DataFrame) -> DataFrame:
    return items.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, new ones in place of old."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__v")))
    return both.withColumn("__r", r).where("__r = 1").drop("__v", "__r")


def current_version(cache: DataFrame, versions: tuple[int, ...], to: int) -> DataFrame:
    """Entries of known versions, brought to the current one; others are left out."""
    return cache.where(F.col("version").isin(*versions, to)).withColumn("version", F.lit(to))


def table_hash(df: DataFrame, *cols: str) -> DataFrame:
    """One row: a hash of the rows that does not depend on their order, from counts and two independent sums of row hashes."""
    h = F.xxhash64(*cols)
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)
    sums = df.agg(F.count("*").alias("n"), F.sum(low).alias("a"), F.sum(high).alias("b"))
    return sums.select("n", F.sha2(F.concat_ws("|", "n", "a", "b"), 256).alias("hash"))


def ordered_hash(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """Per ``key`` the SHA-256 of its rows' hashes in sorted order."""
    row = F.sha2(F.concat_ws("|", *cols), 256)
    return df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ","), 256).alias("hash"))


def family_index(families: DataFrame) -> DataFrame:
    """family_id with hashes of what represents it, what its text is made from, and its members (``members``: sorted array)."""
    return families.select("family_id", T.stable_hash(F.col("canonical_key"), F.col("node_type")).alias("representative_hash"), T.stable_hash(F.col("summary"), F.col("title")).alias("synthesis_hash"), F.sha2(F.array_join("members", "\n"), 256).alias("member_hash"))


def dependencies(edges: DataFrame) -> DataFrame:
    """Per family: incoming and outgoing edges and neighbours."""
    e = edges.where("src <> dst")
    out = e.select(F.col("src").alias("family_id"), F.col("dst").alias("nbr"), F.col("edge_id").alias("out_id"), F.lit(None).cast("string").alias("in_id"))
    inn = e.select(F.col("dst").alias("family_id"), F.col("src").alias("nbr"), F.lit(None).cast("string").alias("out_id"), F.col("edge_id").alias("in_id"))
    return out.unionByName(inn).groupBy("family_id").agg(F.array_sort(F.collect_set("in_id")).alias("incoming"), F.array_sort(F.collect_set("out_id")).alias("outgoing"), F.array_sort(F.collect_set("nbr")).alias("neighbours"))


def affected(previous: DataFrame, current: DataFrame, edges: DataFrame) -> DataFrame:
    """family_id, state (added, changed, reused, removed), in_review (affected or next to one)."""
    p = previous.select("family_id", F.struct("representative_hash", "synthesis_hash").alias("was"))
    c = current.select("family_id", F.struct("representative_hash", "synthesis_hash").alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "reused").otherwise("changed")
    s = p.join(c, "family_id", "full_outer").select("family_id", state.alias("state"))
    hot = s.where("state IN ('added', 'changed')").select(F.col("family_id").alias("h"))
    e = edges.where("src <> dst")
    near = e.select(F.col("src").alias("h"), F.col("dst").alias("family_id")).union(e.select(F.col("dst").alias("h"), F.col("src").alias("family_id"))).join(hot, "h").select("family_id").distinct().withColumn("near", F.lit(True))
    return s.join(near, "family_id", "left").select("family_id", "state", ((F.col("state") != "removed") & (F.col("state").isin("added", "changed") | F.coalesce("near", F.lit(False)))).alias("in_review"))


def scope_decision(scope: DataFrame, share: float = SHARE, count: int = COUNT) -> DataFrame:
    """One row: affected families, their share, and the fallback (none, full_graph)."""
    hit = F.col("state").isin("added", "changed")
    s = scope.where("state <> 'removed'").agg(F.count("*").alias("n_families"), F.count_if(hit).alias("n_affected"), F.count_if("in_review").alias("n_review"))
    part = F.col("n_affected") / F.greatest(F.lit(1), "n_families")
    full = (part >= share) & ((F.col("n_affected") >= count) | (F.col("n_affected") == F.col("n_families")))
    return s.withColumn("share", part).withColumn("fallback", F.when(full, "full_graph").otherwise("none"))


def severity(share, limit: float):
    """none, watch (over three quarters of the limit) or recommend."""
    return F.when(share >= limit, "recommend").when(share > 0.75 * limit, "watch").otherwise("none")


def splice(previous: DataFrame, rebuilt: DataFrame, touched: DataFrame, key: str = "family_id") -> DataFrame:
    """Untouched rows of ``previous`` with ``rebuilt`` in place of the rest."""
    return previous.join(touched.select(key).distinct(), key, "left_anti").select(*rebuilt.columns).unionByName(rebuilt)


def keep_ids(previous: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(new_id, family_id): a rebuilt family (``family_id, node_id``) takes the old id where the two match one to one in members' families."""
    m = rebuilt.select(F.col("family_id").alias("new_id"), "node_id").join(previous.select(F.col("family_id").alias("old_id"), "node_id"), "node_id").select("new_id", "old_id").distinct()
    one_new = m.groupBy("new_id").agg(F.count("*").alias("n"), F.first("old_id").alias("old_id")).where("n = 1").drop("n")
    one_old = m.groupBy("old_id").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    keep = one_new.join(one_old, "old_id")
    ids = rebuilt.select(F.col("family_id").alias("new_id")).distinct()
    return ids.join(keep, "new_id", "left").select("new_id", F.coalesce("old_id", "new_id").alias("family_id"))


def same_run(state: DataFrame, **wanted) -> bool:
    """Whether a one-row state has all wanted values, so that its run can be resumed."""
    row = state.select(*wanted).limit(1).collect()
    return bool(row) and all(row[0][k] == v for k, v in wanted.items())
