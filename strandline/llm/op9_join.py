"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters; an n-gram is ``GRAM`` words, and a shorter text
is one n-gram of all its words. Two texts are linked if their n-gram sets have a Jaccard similarity of ``THRESHOLD`` or more.
``bands_for`` picks bands and rows for a target recall at the threshold.

1. One pass signs every whole text: a 128-bit key of its words, and one hash per band. Texts with the same words are one
   representative with a number of copies; copies are never expanded.
2. Representatives shuffle on (band, hash). A bucket is only counted and given its smallest key (pre-aggregated), which yields one
   edge per member, never pairs; components of those edges hold all candidates of a text.
3. A component of one block (bounded rows and characters) goes, with its texts, to one task, which compares the pairs that share a band and
   returns sums, one row per text. Small components share tasks. Larger components, which bands may have chained from texts that have
   little in common, are compared bucket by bucket instead: a bucket of k blocks is k * (k + 1) / 2 tiles, a pair counts in the first band
   that it shares, and buckets with the same members as one of an earlier band are left out.
4. Verified links give classes (components again) and each document's number of links.

Null texts and texts without a word have no n-gram: they link to nothing and are a class of their own each, with a null class_id only if doc_id
is null. ``class_id`` is the smallest doc_id of the class; ``n_links`` counts the other documents, copies included, that pass the
threshold. Repeated rows are copies. Comparing hashed n-grams (64 bits) errs with a chance below 1e-12 a pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, cut_python, fresh, light, need, release, row_key
from .components import connected

GRAM, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9995, 110
BLOCK_ROWS, BLOCK_CHARS = 2048, 16_000_000
#: Characters of small components that share one task.
SHARED_CHARS = 4_000_000

#: A-Z to a-z, other ASCII that is no letter or digit to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose needed bands stay within ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, 12):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def words_of(text: str | None) -> bytes:
    """The words, one space between them."""
    return b" ".join((text or "").encode().translate(FOLD).split())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


def grams(texts: list[bytes], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all texts, and how many each text has. A span's hash is a difference of prefix sums."""
    counts, parts = np.zeros(len(texts), np.int64), []
    top = max(map(len, texts), default=0)
    up, down = _powers(BASE, top), _powers(INVERSE, top)
    for k, t in enumerate(texts):
        if not t:
            continue
        b = np.frombuffer(t, np.uint8)
        gaps = np.flatnonzero(b == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
        if len(starts) > gram:
            starts, ends = starts[: 1 - gram], ends[gram - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        parts.append((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        counts[k] = len(starts)
    return _mix(np.concatenate(parts)) if parts else np.zeros(0, np.uint64), counts


def band_hashes(hashes: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of ``bands`` hashes for each text that has an n-gram."""
    rng = np.random.default_rng(20)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    first = (np.cumsum(counts) - counts)[counts > 0]
    low = np.empty((len(first), bands * rows), np.uint64)
    room = np.empty_like(hashes)
    for k, m in enumerate(mul):
        np.multiply(hashes, m, out=room)
        room ^= room >> np.uint64(32)
        low[:, k] = np.minimum.reduceat(room, first)
    out = np.zeros((len(first), bands), np.uint64)
    for r in range(rows):
        out = _mix(out * BASE + low[:, r::rows])
    return out.view(np.int64)


def signed(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys``, doc_id, key (null without a word), n_chars, bands."""
    bands, rows = bands_for()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [words_of(t) for t in b["text"]]
            hashes, counts = grams(texts)
            got = iter(band_hashes(hashes, counts, bands, rows)) if counts.any() else iter(())
            out = b[list(keys)].copy()
            out["key"] = [hashlib.blake2b(t, digest_size=16).hexdigest() if t else None for t in texts]
            out["size"] = [len(t) for t in texts]
            out["bands"] = [next(got) if n else None for n in counts]
            yield out

    return need(docs, *keys, "text").mapInPandas(bounded(run, "text", 500), f"{kinds}, key string, size long, bands array<long>")


def compare(left: pd.DataFrame, right: pd.DataFrame | None, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that share a band and pass the threshold, within ``left`` or between it and ``right``; only pairs whose first shared band is ``band``, if given (then all share it)."""
    both = left if right is None else pd.concat([left, right], ignore_index=True)
    n, cross = len(left), right is not None
    bands = np.array(both["bands"].to_list(), np.int64).reshape(len(both), -1)
    hashes, counts = grams([words_of(t) for t in both["text"]])
    ends = np.cumsum(counts)
    sets = [np.unique(hashes[e - c : e]) for e, c in zip(ends, counts, strict=True)]
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.cumsum(size) - size
    mark = np.zeros(codes.max(initial=-1) + 1, bool)
    order = [np.argsort(bands[:, b], kind="stable") for b in range(bands.shape[1] if band < 0 else 0)]
    low = [np.searchsorted(bands[o, b], bands[:, b], "left") for b, o in enumerate(order)]
    high = [np.searchsorted(bands[o, b], bands[:, b], "right") for b, o in enumerate(order)]
    one, two = [], []
    for i in range(n):  # each text's candidates at once, each once over all bands
        if band < 0:
            near = np.concatenate([o[lo[i] : hi[i]] for o, lo, hi in zip(order, low, high, strict=True) if hi[i] - lo[i] > 1] or [np.zeros(0, np.int64)])
            near = np.unique(near[near >= n] if cross else near[near > i])
        else:
            near = np.arange(n if cross else i + 1, len(both))
            near = near[~(bands[near, :band] == bands[i, :band]).any(1)]
        near = near[np.minimum(size[near], size[i]) >= THRESHOLD * np.maximum(size[near], size[i])]
        if not len(near):
            continue
        own = codes[at[i] : at[i] + size[i]]
        mark[own] = True
        for part in np.array_split(near, max(1, int(size[near].sum() // 4_000_000))):
            want = size[part]
            stop = np.cumsum(want)
            flat = np.repeat(at[part] - (stop - want), want) + np.arange(stop[-1])
            shared = np.add.reduceat(mark[codes[flat]].astype(np.int64), stop - want)
            hit = part[shared >= THRESHOLD * (want + size[i] - shared) - 1e-9]
            one.append(np.full(len(hit), i))
            two.append(hit)
        mark[own] = False
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64),) * 2


def tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per linked text of a tile: its links there, weighted by copies, and the smallest key it reaches there."""
    pdf = pdf.sort_values("key", ignore_index=True)
    band = int(pdf["band"].iloc[0])
    inner = (pdf["ti"] == pdf["tj"]).all()
    if inner:
        both = pdf
        a, b = compare(both, None, band)
    else:
        left, right = pdf[pdf["block"] == pdf["ti"]], pdf[pdf["block"] == pdf["tj"]]
        both = pd.concat([left, right], ignore_index=True)
        a, b = compare(left.reset_index(drop=True), right.reset_index(drop=True), band)
    copies = both["copies"].to_numpy(np.int64)
    links = np.zeros(len(both), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    rank = both["key"].rank(method="dense").to_numpy(np.int64) - 1
    label, was = rank.copy(), None
    while was is None or (label != was).any():
        was = label.copy()
        np.minimum.at(label, a, was[b])
        np.minimum.at(label, b, label[a])
    names = np.array(sorted(set(both["key"])), object)
    on = links > 0
    out = pd.DataFrame({"key": both["key"][on], "root": names[label[on]], "links": links[on]})
    if len(both) > 200:
        release()
    return out


def linked(docs: DataFrame, tag: str = "join") -> DataFrame:
    """rid (of ``row_key``), doc_id, class_key, class_id, n_links for every row."""
    rid, = fresh(docs.columns, "rid")
    keyed = docs.withColumn(rid, row_key(F.col("doc_id"), F.col("text")))
    rows = cut_python(signed(keyed, rid, "doc_id").withColumnRenamed(rid, "rid"), f"{tag}-signed")
    reps = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    reps = cut(reps, f"{tag}-reps")
    cells = reps.select("key", F.posexplode("bands").alias("band", "hash"))
    buckets = cells.groupBy("band", "hash").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = cells.join(buckets, ["band", "hash"]).select(F.col("key").alias("a"), "b")
    groups = connected(edges, f"{tag}-near").withColumnRenamed("node", "key")
    spread = reps.join(groups, "key").select("key", "rep", "copies", "bands", "size", F.col("root").alias("comp"))
    blocks = lambda size: F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(size) / BLOCK_CHARS), F.lit(1)).cast("int")
    # without the edges of one member to itself a component has two texts or more
    sizes = spread.groupBy("comp").agg(blocks("size").alias("k"), F.sum("size").alias("chars"))
    sizes = cut(sizes, f"{tag}-sizes")  # a table of its own, so that a hot component's rows can be split in the join
    total = sizes.where("k = 1").agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    shared = max(1, math.ceil(total / SHARED_CHARS))
    spread = cut(spread.join(light(sizes, F.length("comp") + 60), "comp"), f"{tag}-spread")
    home = F.concat(F.lit("-"), F.pmod(F.xxhash64("comp"), F.lit(shared)).cast("string"))
    small = spread.where("k = 1").select("key", "rep", "copies", "bands", home.alias("home"), F.lit(-1).alias("band"), F.lit(0).alias("block"), "k")
    within = spread.where("k > 1").select("key", "size", F.posexplode("bands").alias("band", "hash"))
    members = within.groupBy("band", "hash").agg(F.count("*").alias("n"), blocks("size").alias("k"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 31))).alias("y")).where("n > 1")
    kept = cut(members.groupBy("n", "x", "y").agg(F.min(F.struct("band", "hash", "k")).alias("b")).select("b.*"), f"{tag}-buckets")
    placed = within.join(light(kept, 40), ["band", "hash"]).select("key", "band", F.concat_ws(":", "band", "hash").alias("home"), F.pmod(F.xxhash64("key", F.lit(7)), F.col("k").cast("long")).cast("int").alias("block"), "k")
    large = spread.drop("k").join(placed, "key").select("key", "rep", "copies", "bands", "home", "band", "block", "k")
    spread = cut(small.unionByName(large), f"{tag}-placed")
    wanted = cut(spread.select("rep").distinct(), f"{tag}-wanted")
    texts = keyed.select(F.col(rid).alias("rep"), F.col("text").alias("text")).join(light(wanted, F.length("rep") + 40), "rep").dropDuplicates(["rep"]).join(spread, "rep")
    tiles = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")).select("key", "copies", "bands", "text", "home", "band", "block", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"))
    checked = cut(tiles.groupBy("home", "ti", "tj").applyInPandas(tile, "key string, root string, links long"), f"{tag}-checked")
    classes = connected(checked.select(F.col("key").alias("a"), F.col("root").alias("b")), f"{tag}-class").withColumnRenamed("node", "key")
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    named = reps.select("key", "low", "copies").join(links, "key", "left").join(classes, "key", "left")
    named = cut(named.select("key", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("class_key")), f"{tag}-named")
    lows = named.groupBy("class_key").agg(F.min("low").alias("class_id"))
    of_key = named.join(lows, "class_key").select("key", "class_key", "class_id", "n_links")
    out = rows.select("rid", "doc_id", "key").join(of_key, "key", "left")
    return out.select("rid", "doc_id", "class_key", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op9_ngram_join(spark, sf_dir) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), "op9").select("doc_id", "class_id", "n_links")


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the smallest doc_id (then key). Documents without a word stay, each row of them."""
    (key, k2) = fresh(docs.columns, "rid", "rid2")
    rows = cut(linked(docs, "stage").where("class_key IS NOT NULL"), "stage-linked")
    best = rows.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid"))["rid"].alias("rid"))
    gone = cut(rows.select("rid").distinct().join(best, "rid", "left_anti").select(F.col("rid").alias(k2)), "stage-gone")
    again = rows.join(best, "rid", "left_semi").groupBy("rid").agg(F.count("*").alias("n")).where("n > 1")
    again = cut(again.select(F.col("rid").alias(k2)), "stage-again")  # rows that stay and stand there more than once
    wide = F.length(k2) + 40
    left = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(light(gone, wide), F.col(key) == F.col(k2), "left_anti")
    if not again.isEmpty():
        few = light(again, wide)
        left = left.join(few, F.col(key) == F.col(k2), "left_anti").unionByName(left.join(few, F.col(key) == F.col(k2), "left_semi").dropDuplicates([key]))
    return left.select(*(f"`{c}`" for c in docs.columns))
