"""Line dedup by content-defined chunks: repeated multi-line chunks are removed wherever they occur but once.

1. Lines (split at ``\\n``) are hashed and counted over the corpus. Only documents with a repeated line go on.
2. Chunks: a rolling hash (polynomial, over the hashes of the last few lines) alone decides where a text is cut. If the hash of the lines
   i .. i + w - 1 is 0 modulo a divisor there is a boundary behind them, if another part of it is there is one before them; so a passage sets
   boundaries at both its ends itself, and lines put in or taken out elsewhere move none. ``LEVELS`` gives windows and divisors: small
   windows find short passages, larger ones find passages whose lines also occur alone.
3. Chunks found twice or more are matched with their first occurrence and extended over the neighbouring lines that are equal there
   (up to ``CONTEXT`` lines; longer stretches hold a boundary). Adjacent matches with the same part of the same text are one run. Runs
   of two lines and ``least`` words go, after a byte comparison: run and source are grouped by the text itself.
4. What boundaries part in another way in each copy, and long single lines, an exact pass completes (``passages``): the shortest windows of
   repeated lines with ``LONG_WORDS`` words, from each line on and up to each line, that still have a line which no run takes, are
   compared with their first occurrence in the same way. So every later occurrence of a passage of ``LONG_WORDS`` words goes.
5. The occurrence with the smallest (doc_id, place) stays; the others' lines go. Everything else of a text stays as it was.

Null texts have no line and stay null. Null doc_ids come after all others. Repeated rows (same doc_id and text) are one document with
one decision; equal texts under different doc_ids are copies and lose what the first keeps. Hot lines and chunks are counted with
partial aggregation and joined as skewed keys, never gathered. What is decided about documents is narrow; it is broadcast to their
texts while its counted rows stay within a bound, and beyond it the texts are shuffled to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, cut, cut_python, fresh, light, need, row_key

#: (lines in the rolling hash's window, divisor) of each level of chunks.
LEVELS = ((1, 3), (2, 3), (3, 6))
CONTEXT, LONG_WORDS, LEAST_WORDS = 8, 50, 20
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


def cuts(h: np.ndarray, window: int, divisor: int) -> np.ndarray:
    """Boundaries (0, the number of lines, and places between) of a text with line hashes ``h``. A window's hash is a difference of prefix sums."""
    n, edge = len(h), np.zeros(len(h) + 1, bool)
    edge[[0, n]] = True
    if n >= window:
        upto = np.zeros(n + 1, np.uint64)
        np.cumsum(h.view(np.uint64) * _powers(INVERSE, n - 1), out=upto[1:])
        rolled = (upto[window:] - upto[: n + 1 - window]) * _powers(BASE, n - window)
        rolled = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        edge[window:] |= (rolled >> np.uint64(40)) % np.uint64(divisor) == 0
        edge[: n + 1 - window] |= ((rolled >> np.uint64(16)) & np.uint64(0xFFFFFF)) % np.uint64(divisor) == 0
    return np.flatnonzero(edge)


def key_of(h: np.ndarray, s: int, e: int) -> str:
    return hashlib.blake2b(h[s:e].tobytes(), digest_size=16).hexdigest()


def chunks(lines: DataFrame) -> DataFrame:
    """Chunks of repeated lines: rid, z, d (doc_id, null last), s, e (line range), key, and, of the up to ``CONTEXT`` repeated lines before and behind, the hashes
    (hb, ha; nearest first) and the text's words up to them (wb, wa; the chunk's own edge first)."""
    names = ["rid", "z", "d", "s", "e", "key", "hb", "ha", "wb", "wa"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, z, d, h, w, n in zip(b["rid"], b["z"], b["d"], b["h"], b["w"], b["n"], strict=True):
                h, n = np.asarray(h, np.int64), np.asarray(n)
                words, once = np.append(0, np.cumsum(np.asarray(w, np.int64))), np.append(0, np.cumsum(n < 2))
                places = np.arange(len(h))
                low = np.maximum(np.maximum.accumulate(np.where(n < 2, places + 1, 0)), 0)  # first line of the stretch of repeated lines
                high = np.minimum.accumulate(np.where(n < 2, places, len(h))[::-1])[::-1]  # and the line behind it
                spans = set()
                for level in LEVELS:
                    at = cuts(h, *level)
                    full = once[at[:-1]] == once[at[1:]]
                    spans.update(zip(at[:-1][full].tolist(), at[1:][full].tolist(), strict=True))
                for s, e in sorted(spans):
                    lo, hi = max(int(low[s]), s - CONTEXT), min(int(high[e - 1]), e + CONTEXT)
                    out.append((rid, z, d, s, e, key_of(h, s, e), h[lo:s][::-1], h[e:hi], words[lo : s + 1][::-1], words[e : hi + 1]))
            yield pd.DataFrame(out, columns=names).astype({"s": "int32", "e": "int32", "z": bool})

    kind = lines.schema["d"].dataType.simpleString()
    flat = lines.selectExpr("rid", "z", "d", "l.h AS h", "l.w AS w", "l.n AS n")
    return flat.mapInPandas(bounded(run, "h", chars=400_000), f"rid string, z boolean, d {kind}, s int, e int, key string, hb array<long>, ha array<long>, wb array<long>, wa array<long>")


#: Where an occurrence stands: null doc_ids last.
PLACE = "struct(z, d, rid AS r, s AS p)"


def runs(found: DataFrame, least: int, tag: str) -> DataFrame:
    """Runs of later occurrences: rid, s, e, source (rid of the text that keeps it), offset (s less its place there)."""
    first = found.groupBy("key").agg(F.min(F.expr("struct(z, d, rid AS r, s AS p, hb, ha)")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = cut(first, f"{tag}-first")
    later = found.join(light(first, F.length("key") + F.length("first.r") + 8 * (F.size("first.hb") + F.size("first.ha")) + 100), "key").where("rid <> first.r OR s >= first.p + e - s")
    equal = lambda side: f"IF(rid = first.r, 0, coalesce(nullif(array_position(zip_with({side}, first.{side}, (a, b) -> coalesce(a = b, false)), false), 0) - 1, size({side})))"
    grown = later.selectExpr("rid", "first.r AS source", "s", "e", "s - first.p AS offset", "wb", "wa", f"cast({equal('hb')} AS int) AS kb", f"cast({equal('ha')} AS int) AS ka")
    grown = grown.selectExpr("rid", "source", "offset", "s - kb AS s", "e + ka AS e", "wb[kb] AS ws", "wa[ka] AS we", "IF(rid = source, s, -1) AS own")
    # adjacent or overlapping ranges of one text that match one stretch of another
    by = Window.partitionBy("rid", "source", "offset", "own").orderBy("s", "e")
    parted = grown.withColumn("new", (F.col("s") > F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    parted = parted.withColumn("nth", F.sum(F.coalesce("new", F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parted.groupBy("rid", "source", "offset", "own", "nth").agg(F.min("s").alias("s"), F.max("e").alias("e"), (F.max("we") - F.min("ws")).alias("words"))
    return whole.where((F.col("e") - F.col("s") >= 2) & (F.col("words") >= least)).select("rid", "s", "e", "source", "offset")


def shortest(words: np.ndarray, once: np.ndarray) -> list[tuple[int, int]]:
    """Line ranges, none of their lines found ``once``, that reach ``LONG_WORDS`` words with no line to spare at their end or start."""
    upto, ones, at = np.append(0, np.cumsum(words)), np.append(0, np.cumsum(once)), np.arange(len(words))
    s = np.concatenate([at, np.searchsorted(upto, upto[1:] - LONG_WORDS, "right") - 1])
    e = np.concatenate([np.searchsorted(upto, upto[:-1] + LONG_WORDS), at + 1])
    fits = (s >= 0) & (e < len(upto)) & (e > s)
    s, e = s[fits], e[fits]
    fits = ones[s] == ones[e]
    return sorted(set(zip(s[fits].tolist(), e[fits].tolist(), strict=True)))


def windows(lines: DataFrame, later: DataFrame) -> DataFrame:
    """The shortest windows of ``lines`` as rid, z, d, s, e, key, open (a line of it is in none of the document's ranges in ``later``: rid, gone)."""


    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, z, d, h, w, n, ss, es in zip(b["rid"], b["z"], b["d"], b["h"], b["w"], b["n"], b["ss"], b["es"], strict=True):
                h, left = np.asarray(h, np.int64), np.ones(len(h), np.int64)
                for s, e in zip(ss, es, strict=True) if ss is not None else ():
                    left[s:e] = 0
                left = np.append(0, np.cumsum(left))
                out += [(rid, z, d, s, e, key_of(h, s, e), bool(left[e] > left[s])) for s, e in shortest(np.asarray(w, np.int64), np.asarray(n) < 2)]
            yield pd.DataFrame({c: pd.Series([x[k] for x in out], dtype=t) for k, (c, t) in enumerate({"rid": object, "z": bool, "d": b["d"].dtype, "s": "int32", "e": "int32", "key": object, "open": bool}.items())})

    # later copies of whole texts go anyway, and hold no first occurrence
    rest = lines.join(later, "rid", "left").where("NOT coalesce(exists(gone, x -> x.s = 0 AND x.e = size(l)), false)")
    flat = rest.selectExpr("rid", "z", "d", "l.h AS h", "l.w AS w", "l.n AS n", "gone.s AS ss", "gone.e AS es")
    return flat.mapInPandas(bounded(run, "h", chars=400_000), f"rid string, z boolean, d {lines.schema['d'].dataType.simpleString()}, s int, e int, key string, open boolean")


def repeated(docs: DataFrame, tag: str = "lines", passages: bool = False, least: int = LEAST_WORDS) -> DataFrame:
    """rid, removed (sorted array of line ranges s, e), n_lines, removed_lines, removed_words, for documents that lose a run or, if ``passages``, a window."""
    keyed = need(docs, "doc_id", "text").where("text IS NOT NULL").withColumn("rid", row_key(F.col("doc_id"), F.col("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = keyed.selectExpr("rid", "text", "doc_id IS NULL AS z", f"coalesce(doc_id, cast(0 AS {kind})) AS d")
    split = keyed.selectExpr("rid", "z", "d", "split(text, '\\n', -1) AS lines").selectExpr("rid", "z", "d", "transform(lines, x -> xxhash64(x)) AS hs", f"transform(lines, x -> regexp_count(x, '{WORD}')) AS ws")
    rows = cut(split.groupBy("rid").agg(F.first("z").alias("z"), F.first("d").alias("d"), F.first("hs").alias("hs"), F.first("ws").alias("ws")), f"{tag}-hashes")
    flat = rows.select("rid", "z", "d", F.posexplode(F.arrays_zip("hs", "ws")).alias("pos", "x")).select("rid", "z", "d", "pos", F.col("x.hs").alias("h"), F.col("x.ws").alias("w"))
    twice = cut(rows.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), f"{tag}-twice")
    counted = flat.join(light(twice, 24), "h", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    lines = counted.groupBy("rid").agg(F.first("z").alias("z"), F.first("d").alias("d"), F.array_sort(F.collect_list(F.struct("pos", "h", "w", "n"))).alias("l"), F.max("n").alias("most")).where("most > 1")
    lines = cut(lines, f"{tag}-counted")
    again = cut(runs(cut_python(chunks(lines), f"{tag}-chunks"), least, tag), f"{tag}-runs")
    source = "concat_ws(':', source, s - offset, e - offset) AS key"
    spans = again.selectExpr("rid", "s", "e", source).unionByName(again.selectExpr("source AS rid", "s - offset AS s", "e - offset AS e", source).distinct())
    if passages:
        later = again.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
        short = cut_python(windows(lines, later), f"{tag}-windows")
        place = F.expr(PLACE)
        missed = cut(short.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.bool_or("open").alias("some")).where("n > 1 AND some").select("key", "first"), f"{tag}-missed")
        more = short.join(light(missed, F.length("key") + F.length("first.r") + 80), "key").where("open AND (rid <> first.r OR s >= first.p + e - s) OR rid = first.r AND s = first.p")
        spans = spans.unionByName(more.select("rid", "s", "e", "key"))
    per_doc = cut(spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e", "key")).alias("cs")), f"{tag}-candidates")
    place, second = F.expr(PLACE), "rid <> first.r OR s >= first.p + e - s"
    texts = keyed.join(light(per_doc.select("rid"), F.length("rid") + 40), "rid").join(per_doc, "rid").dropDuplicates(["rid"]).selectExpr("rid", "z", "d", "cs", "split(text, '\\n', -1) AS lines")
    body = "explode(transform(cs, c -> struct(c.s AS s, c.e AS e, c.key AS key, array_join(slice(lines, c.s + 1, c.e - c.s), '\\n') AS body))) AS c"
    bodies = texts.selectExpr("rid", "z", "d", "size(lines) AS n_lines", body)
    bodies = cut(bodies.select("rid", "z", "d", "n_lines", "c.*"), f"{tag}-bodies")
    firsts = cut(bodies.groupBy("key", "body").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "body", "first"), f"{tag}-firsts")
    gone = bodies.join(firsts, ["key", "body"]).where(second)
    # windows may overlap: each line goes once
    by_line = gone.selectExpr("rid", "n_lines", f"transform(split(body, '\\n', -1), (x, k) -> struct(s + k AS p, regexp_count(x, '{WORD}') AS w)) AS part")
    sums = by_line.groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("part")))).alias("g"), F.first("n_lines").alias("n_lines"))
    starts, ends = "transform(filter(g, (x, k) -> k = 0 OR g[k - 1].p < x.p - 1), x -> x.p)", "transform(filter(g, (x, k) -> k = size(g) - 1 OR g[k + 1].p > x.p + 1), x -> x.p + 1)"
    return sums.selectExpr("rid", f"zip_with({starts}, {ends}, (a, b) -> struct(a AS s, b AS e)) AS removed", "n_lines", "cast(size(g) AS bigint) AS removed_lines", "aggregate(g, 0L, (a, x) -> a + x.w) AS removed_words")


def without_repeats(docs: DataFrame, tag: str = "lines", passages: bool = False, least: int = LEAST_WORDS) -> tuple[DataFrame, list[str]]:
    """``docs`` with text cut, and the names of added columns: removed_lines, removed_words, and whether nothing but blanks is left."""
    names = fresh(docs.columns, "rid", "rid2", "removed", "removed_lines", "removed_words", "emptied", "gap_lines")
    rid, rid2, removed, n_lines, n_words, emptied, total = names
    gone = cut(repeated(docs, tag, passages, least), f"{tag}-removed").select(F.col("rid").alias(rid2), F.col("removed").alias(removed), F.col("removed_lines").alias(n_lines), F.col("removed_words").alias(n_words), F.col("n_lines").alias(total))
    joined = docs.withColumn(rid, row_key(F.col("doc_id"), F.col("text"))).join(light(gone, F.length(rid2) + 24 * F.size(removed) + 100), F.col(rid) == F.col(rid2), "left")
    keep = f"""transform(array(split(`text`, '\\n', -1)), x -> array_join(flatten(transform(sequence(0, size({removed})),
        k -> slice(x, IF(k = 0, 0, {removed}[k - 1].e) + 1, IF(k = size({removed}), {total}, {removed}[k].s) - IF(k = 0, 0, {removed}[k - 1].e)))), '\\n'))[0]"""
    left = joined.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.expr(keep)))
    left = left.withColumn(emptied, F.col(removed).isNotNull() & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return left, [n_lines, n_words, emptied]


def op2_line_chunks(spark, sf_dir) -> DataFrame:
    left, (lines, words, _) = without_repeats(need(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), "op2", passages=True)
    return left.select("doc_id", F.coalesce(lines, F.lit(0)).cast("long").alias("removed_lines"), F.coalesce(words, F.lit(0)).cast("long").alias("removed_words"), "text")


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks, n_chars to match; documents of which nothing but blanks is left go, being copies."""
    left, (_, _, emptied) = without_repeats(docs, "stage", passages=True)
    left = left.where(~F.coalesce(F.col(emptied), F.lit(False)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*(f"`{c}`" for c in docs.columns))
