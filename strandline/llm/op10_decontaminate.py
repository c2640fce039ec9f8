"""Benchmark decontamination by winnowing, in SQL functions alone.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. A document word is hit if it lies in an
occurrence of a window: ``SPAN`` consecutive words of an item, or a whole item of fewer.

1. Fingerprints: of every ``SPAN - GRAM + 1`` successive hashes of ``GRAM`` words the least is kept. Two texts that share ``SPAN`` words
   share a whole such stretch, hence its least hash: no shared span is missed. Documents and items are treated alike.
   Items of fewer words have one hash of all their words, met by documents' hashes of that many words; this is computed only for
   lengths that occur.
2. Documents that share a fingerprint with an item are candidates.
3. Each hit is extended on the real words: every window of a candidate is joined, as text, with the distinct windows of the items. A
   window's items are one set, and equal sets are one row, so a passage that thousands of items share meets a document once.

Fingerprints only propose; texts decide, so collisions do no harm. Sides are broadcast while their measured bytes are few, and
shuffled otherwise. Null texts and texts without a word have no window and no hit. Repeated rows are judged alike; items with
the same item_id count once, and a null item_id counts but is not listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, light, need, row_key

SPAN, GRAM = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def with_words(df: DataFrame) -> DataFrame:
    """Adds words and n (their number)."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return df.selectExpr("*", f"array_remove(split({low}, '{BREAKS}'), '') AS words").selectExpr("*", "size(words) AS n")


def _shift(a: str, b: str, by: int, size: str, op: str) -> str:
    """op of each element of ``a`` with the one of ``b`` that stands ``by`` further on."""
    return f"zip_with(slice({a}, 1, greatest({size}, 0)), slice({b}, {1 + by}, greatest({size}, 0)), (x, y) -> {op})"


def gram_hashes(df: DataFrame, size: int, name: str) -> DataFrame:
    """Adds ``name``: the hashes of all ``size``-word grams, joined from grams of powers of two (``df`` has words and n)."""
    keep = df.columns
    df = df.selectExpr("*", "transform(words, w -> xxhash64(w)) AS g1")
    have, top = 1, "g1"
    mix = "xxhash64(x, y)"
    while have < size:
        step = 1 << min(have, size - have).bit_length() - 1
        df = df.selectExpr("*", _shift(top, f"g{step}", have, f"n - {have + step - 1}", mix) + f" AS g{have + step}")
        have += step
        top = f"g{have}"
    return df.selectExpr(*keep, f"{top} AS {name}")


def winnowed(df: DataFrame) -> DataFrame:
    """Adds fps: the distinct least hashes of all windows."""
    keep = df.columns
    width = SPAN - GRAM + 1
    df = gram_hashes(df, GRAM, "m1")
    have, top = 1, "m1"
    while have < width:
        step = 1 << min(have, width - have).bit_length() - 1
        df = df.selectExpr("*", _shift(top, f"m{step}", have, f"n - {GRAM + have + step - 2}", "least(x, y)") + f" AS m{have + step}")
        have += step
        top = f"m{have}"
    return df.selectExpr(*keep, f"array_distinct({top}) AS fps")


def short_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Extends fps by the hashes of all grams of each of ``lengths`` words, so that short items are found."""
    for k in lengths:
        df = gram_hashes(df, k, "short").selectExpr(*(c for c in df.columns if c != "fps"), "array_distinct(concat(fps, short)) AS fps")
    return df


def items_of(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """item, item_id, len, windows, fps of the items that have a word, and the lengths of those below ``SPAN``."""
    rows = need(benchmark, "item_id", "text").withColumn("item", row_key(F.col("item_id"), F.col("text"))).dropDuplicates(["item"])
    rows = with_words(rows).where("n > 0")
    rows = winnowed(rows)
    for k in range(1, SPAN):
        rows = gram_hashes(rows, k, f"s{k}")
    own = "CASE n " + " ".join(f"WHEN {k} THEN s{k}" for k in range(1, SPAN)) + " ELSE fps END"
    span = f"least(n, {SPAN})"
    rows = rows.selectExpr("item", "item_id", f"{span} AS len", f"array_distinct(transform(sequence(1, n - {span} + 1), i -> array_join(slice(words, i, {span}), ' '))) AS windows", f"{own} AS fps")
    rows = cut(rows, "items")
    return rows, sorted(r["len"] for r in rows.where(f"len < {SPAN}").select("len").distinct().collect())


def contamination(docs: DataFrame, benchmark: DataFrame, tag: str = "decontam") -> DataFrame:
    """rid, doc_id, n_words, n_hit, n_items, items (sorted ids as strings) for every row of ``docs``; spans too (start, end words)."""
    items, lengths = items_of(benchmark)
    keyed = need(docs, "doc_id", "text").withColumn("rid", row_key(F.col("doc_id"), F.col("text")))
    prints = short_grams(winnowed(with_words(keyed).select("rid", "doc_id", "words", "n")), lengths)
    prints = cut(prints.select("rid", "doc_id", F.col("n").cast("long").alias("n_words"), "fps"), f"{tag}-prints")
    wanted = cut(items.select(F.explode("fps").alias("fp")).distinct(), f"{tag}-wanted")
    near = cut(prints.select("rid", F.explode("fps").alias("fp")).join(light(wanted, 16), "fp").select("rid").distinct(), f"{tag}-near")

    each = items.select(F.col("item_id").cast("string").alias("id"), "len", F.explode("windows").alias("w"))
    windows = each.groupBy("len", "w").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.max(F.col("id").isNull().cast("int")).alias("anon"))
    windows = cut(windows.withColumn("sid", F.sha2(F.to_json(F.struct("ids", "anon")), 256)), f"{tag}-windows")
    sets = cut(windows.groupBy("sid").agg(F.first("ids").alias("ids"), F.first("anon").alias("anon")), f"{tag}-sets")

    words = with_words(keyed.join(light(near, F.length("rid") + 40), "rid").dropDuplicates(["rid"])).select("rid", "words")
    # the words are bound to a lambda's variable: as a column, the optimiser would put the split itself into the inner loop
    at = lambda k: f"IF(size(w) < {k}, array(), transform(sequence(1, size(w) - {k - 1}), i -> struct(i AS s, {k} AS len, array_join(slice(w, i, {k}), ' ') AS w)))"
    places = words.selectExpr("rid", f"explode(transform(array(words), w -> concat({', '.join(at(k) for k in sorted({*lengths, SPAN}))}))[0]) AS x").select("rid", "x.*")
    hits = cut(places.join(light(windows.select("len", "w", "sid"), F.octet_length("w") + 120), ["len", "w"]).select("rid", "s", "len", "sid"), f"{tag}-hits")

    found = hits.select("rid", "sid").distinct().join(light(sets, F.size("ids") * 24 + 100), "sid")
    anon = found.groupBy("rid").agg(F.max("anon").alias("anon"))
    ids = found.select("rid", F.explode("ids").alias("id")).distinct().groupBy("rid").agg(F.sort_array(F.collect_list("id")).alias("items"))
    spans = hits.groupBy("rid").agg(F.array_sort(F.collect_set(F.expr("struct(s, s + len AS e)"))).alias("spans"))
    cover = "aggregate(spans, struct(0 AS e, 0L AS n), (a, x) -> struct(greatest(a.e, x.e) AS e, a.n + greatest(0, x.e - greatest(a.e, x.s)) AS n), a -> a.n)"
    hit = spans.join(anon, "rid").join(ids, "rid", "left").selectExpr("rid", "spans", f"{cover} AS n_hit", "cast(coalesce(size(items), 0) + anon AS bigint) AS n_items", "items")
    hit = cut(hit, f"{tag}-hit")
    return prints.select("rid", "doc_id", "n_words").join(hit, "rid", "left").selectExpr("rid", "doc_id", "n_words", "coalesce(n_hit, 0L) AS n_hit", "coalesce(n_items, 0L) AS n_items", "coalesce(items, cast(array() AS array<string>)) AS items", "spans")


def op10_decontaminate(spark, sf_dir) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "op10")
    return found.selectExpr("doc_id", "n_words", "n_hit", "n_items", "sha2(array_join(items, ','), 256) AS items_sha256", "n_hit > 0 AS contaminated")


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a hit word go; all columns of the others stay as they are."""
    (key, k2) = fresh(docs.columns, "rid", "rid2")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "stage")
    gone = cut(found.where("n_hit > 0").select(F.col("rid").alias(k2)).distinct(), "stage-gone")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(light(gone, F.length(k2) + 40), F.col(key) == F.col(k2), "left_anti").select(*(f"`{c}`" for c in docs.columns))


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS span FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, span, array_to_string(w[i : i + span - 1], ' ') AS t FROM (SELECT *, unnest(generate_series(1, len(w) - span + 1)) AS i FROM b)),
dw AS (SELECT doc_id, span, i, array_to_string(w[i : i + span - 1], ' ') AS t FROM (SELECT *, unnest(generate_series(1, len(w) - span + 1)) AS i FROM d, (SELECT DISTINCT span FROM b))),
hit AS (SELECT doc_id, i, dw.span, item_id FROM dw JOIN win ON dw.span = win.span AND dw.t = win.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + span - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
