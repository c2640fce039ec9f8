"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source replace fixed cutoffs.

1. Each whole text is measured once (Python, one pass): counts only, no text leaves this step.
2. Every metric is a rate, a count over a base, as a whole number. The rates of the documents that the base rules let through go into
   log-linear sketches: numbers below 64 are their own bucket, larger ones keep their top six bits, so a bucket is at most 1/32 of its
   value wide. Two sketches merge by adding the counts of equal buckets, which is a plain ``groupBy(...).count()`` with partial
   aggregation; a group has at most a few hundred buckets whatever its size. Repeats are rare, so their sketches hold only the
   documents that have any.
3. A group's limit is ``q75 + FENCE * (q75 - q25)`` of its own sketch and nothing else. A metric with under ``MIN_GROUP`` values in a group
   takes the limit of the language (all its sources' sketches merged), and one with so few in the language that of the corpus.
4. Documents join their group's limits. A document is over one if its count exceeds the limit's share of its base by more than
   ``DEVIATIONS`` times the square root of the count, the deviation of a count by chance, so that a few occurrences in a short text prove
   nothing. It is kept if it is over no limit and the base rules pass.

Null or empty texts have no word: every count is 0 and the base rule on words rejects them. Null languages and sources are
groups of their own. Repeated rows count and are judged as often as they occur. Where no document has a metric's event it has no limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, cut, cut_python, fresh, light, need, row_key

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
MIN_WORDS, MAX_REPEAT_SHARE, GRAM = 10, 20, 5
MIN_GROUP, FENCE, DEVIATIONS = 50, 3, 3
#: metric -> (count, base, scale of the rate, whether its sketch holds only documents that have any).
METRICS = {
    "symbol_share": ("n_symbols", "word_chars", 1000, False),
    "shout_share": ("n_shouts", "word_chars", 1000, False),
    "caps_share": ("n_caps", "word_chars", 1000, False),
    "repeat_share": ("n_repeat_words", "n_words", 1000, True),
    "dup_line_share": ("n_dup_lines", "n_lines", 1000, True),
    "word_length": ("word_chars", "n_words", 100, False),
}
BASE = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_SHARE} * n_words)"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_caps long, n_shouts long"


def _codes(values: np.ndarray) -> tuple[np.ndarray, int]:
    codes, found = pd.factorize(values)
    return codes.astype(np.int64), len(found)


def repeat_words(words: list[bytes]) -> int:
    """Words inside ``GRAM``-word windows that occur twice or more; windows are compared exactly, by dense codes."""
    if len(words) <= GRAM:
        return 0
    one, n1 = _codes(np.array(words, object))
    two, n2 = _codes(one[:-1] * n1 + one[1:])
    four, _ = _codes(two[:-2] * n2 + two[2:])
    five, n5 = _codes(four[:-1] * n1 + one[4:])
    if n5 == len(five):
        return 0
    again = np.bincount(five, minlength=n5)[five] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + GRAM, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines with a word, ASCII capitals, exclamation marks."""
    if not text:
        return (0,) * 8
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII blanks
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    chars = len(text) - sum(map(text.count, BLANKS))
    bytes_seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    count = lambda s: int(sum(bytes_seen[ord(c)] for c in s))
    return len(words), chars, count(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines), int(bytes_seen[65:91].sum()), count("!")


def measured(docs: DataFrame, *keys: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keys) + ", " + COUNTS
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([measure(t) for t in b["text"]], columns=names, index=b.index, dtype="int64")
            yield pd.concat([b[list(keys)], got], axis=1)

    return need(docs, *keys, "text").mapInPandas(bounded(run, "text"), schema)


def bucket(v: str) -> str:
    """The sketch's bucket of a whole number, as its smallest number."""
    bits = f"greatest(length(bin({v})) - 6, 0)"
    return f"shiftleft(shiftright({v}, {bits}), {bits})"


def limits(counted: DataFrame) -> DataFrame:
    """One row for each (lang, source), as g_lang and g_source, with an array g_limit in the order of METRICS (null: no limit)."""
    kind = counted.select("lang", "source")
    rate = lambda c, base, scale: f"{c} * {scale} div greatest({base}, 1)"
    pairs = ", ".join(f"{i}, {bucket(name)}, {name} > 0 OR {not some}" for i, (name, (*_, some)) in enumerate(METRICS.items()))
    flat = counted.where(f"NOT {BASE}").selectExpr("lang", "source", *(f"cast({rate(*m[:3])} as bigint) as {name}" for name, m in METRICS.items()))
    cells = flat.selectExpr("lang", "source", f"stack({len(METRICS)}, {pairs}) as (metric, low, counts)").where("counts")
    sketch = cells.groupBy("lang", "source", "metric", "low").agg(F.count("*").alias("n"))

    def fences(by: tuple[str, ...], p: str) -> DataFrame:
        """metric, the columns ``by``, their number of values and fence; names start with ``p``."""
        w = Window.partitionBy(*by, "metric")
        upto = sketch.groupBy(*by, "metric", "low").agg(F.sum("n").alias("n")).select("*", F.sum("n").over(w.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("total"))
        q = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("low")))
        found = upto.groupBy(*by, "metric").agg((q(3) + FENCE * (q(3) - q(1))).alias(f"{p}limit"), F.max("total").alias(f"{p}n"))
        return found.select(F.col("metric").alias(f"{p}metric"), *(F.col(c).alias(f"{p}{c}") for c in by), f"{p}n", f"{p}limit")

    grid = kind.distinct().withColumn("metric", F.explode(F.sequence(F.lit(0), F.lit(len(METRICS) - 1))))
    same = lambda p, *by: reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"{p}{c}")), by, F.col("metric") == F.col(f"{p}metric"))
    near = grid.join(fences(("lang", "source"), "f_"), same("f_", "lang", "source"), "left").join(fences(("lang",), "l_"), same("l_", "lang"), "left")
    near = near.join(F.broadcast(fences((), "a_")), same("a_"), "left")  # a row for each metric
    chosen = F.when(F.col("f_n") >= MIN_GROUP, F.col("f_limit")).when(F.col("l_n") >= MIN_GROUP, F.col("l_limit")).otherwise(F.col("a_limit"))
    rows = near.groupBy("lang", "source").agg(F.array_sort(F.collect_list(F.struct("metric", chosen.alias("v")))).alias("vs"))
    return rows.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.transform("vs", lambda x: x["v"]).alias("g_limit"))


def over_sql(limit: str, count: str, base: str, scale: int) -> str:
    return f"({count} * {scale} - {limit} * {base} > {DEVIATIONS * scale} * sqrt({count}))"


def judge(counted: DataFrame) -> DataFrame:
    """``counted`` with base_failed, n_over (metrics above their limit) and kept."""
    over = " + ".join(f"int(coalesce({over_sql(f'g_limit[{i}]', *m[:3])}, false))" for i, m in enumerate(METRICS.values()))
    near = counted.join(limits(counted), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    return near.selectExpr(*(f"`{c}`" for c in counted.columns), f"{BASE} AS base_failed", f"({over}) AS n_over").withColumn("kept", ~F.col("base_failed") & (F.col("n_over") == 0))


def score_documents(docs: DataFrame, tag: str = "op3") -> DataFrame:
    """Counts, n_over and verdict of every row of ``docs`` (needs doc_id, text, lang, source)."""
    return judge(cut_python(measured(docs, "doc_id", "lang", "source"), f"{tag}-counts"))


def op3_quality_rules(spark, sf_dir) -> DataFrame:
    scored = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; all columns of the others stay as they are."""
    (key, k2) = fresh(docs.columns, "rid", "rid2")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    counted = cut_python(measured(keyed, key, "lang", "source"), "quality-counts")
    gone = cut(judge(counted).where(~F.col("kept")).select(F.col(key).alias(k2)).distinct(), "quality-gone")
    return keyed.join(light(gone, F.length(k2) + 40), F.col(key) == F.col(k2), "left_anti").select(*(f"`{c}`" for c in docs.columns))


def _sql_bucket(v: str) -> str:
    return f"(({v} >> greatest(length(bin({v})) - 6, 0)) << greatest(length(bin({v})) - 6, 0))"


def op3_sql() -> str:
    flat = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, {i} AS metric, {c} * {scale} // greatest({base}, 1) AS v, {c} AS c, {base} AS b, {scale} AS scale, base_failed, ({c} > 0 OR {not some}) AS counts FROM base" for i, (c, base, scale, some) in enumerate(METRICS.values())
    )
    level = """{name}b AS (SELECT *, sum(n) OVER (PARTITION BY {by} metric ORDER BY low) AS upto, sum(n) OVER (PARTITION BY {by} metric) AS total FROM (SELECT {by} metric, low, sum(n) AS n FROM sketch GROUP BY {by} metric, low)),
{name} AS (SELECT {by} metric, max(total) AS n, (min(low) FILTER (upto * 4 >= total * 3)) + {fence} * ((min(low) FILTER (upto * 4 >= total * 3)) - (min(low) FILTER (upto * 4 >= total))) AS lim FROM {name}b GROUP BY {by} metric)"""
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
g AS (SELECT doc_id, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS gram, lead(i, 4) OVER o AS last FROM w0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE last IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) AS s(k) WHERE n > 1 GROUP BY doc_id),
nw AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w0 GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (SELECT d.doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_caps, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_shouts
  FROM d LEFT JOIN nw USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
base AS (SELECT *, {BASE} AS base_failed FROM counts),
flat AS ({flat}),
sketch AS (SELECT lang, source, metric, {_sql_bucket('v')} AS low, count(*) AS n FROM flat WHERE counts AND NOT base_failed GROUP BY ALL),
{level.format(name='fine', by='lang, source,', fence=FENCE)},
{level.format(name='mid', by='lang,', fence=FENCE)},
{level.format(name='every', by='', fence=FENCE)},
over AS (SELECT doc_id FROM flat x LEFT JOIN fine f ON x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source AND x.metric = f.metric
  LEFT JOIN mid m ON x.lang IS NOT DISTINCT FROM m.lang AND x.metric = m.metric LEFT JOIN every e ON x.metric = e.metric
  WHERE c * scale - (CASE WHEN f.n >= {MIN_GROUP} THEN f.lim WHEN m.n >= {MIN_GROUP} THEN m.lim ELSE e.lim END) * b > {DEVIATIONS} * scale * sqrt(c))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over) AS kept FROM base
"""
