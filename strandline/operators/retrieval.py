"""Retrieval over chunks: TF-IDF with capped term counts, title bonus, hit ranks and their mean reciprocal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

CAP, BONUS, TOP, PASS_RANK = 8, 18.0, 8, 5


def chunks(texts: DataFrame, heading: str = r"(?m)^## ") -> DataFrame:
    """``name, body`` -> name, chunk_no, title, text, cut before every heading; what stands before the first is chunk 0 under the name."""
    parts = F.split("body", f"(?=({heading}))" if not heading.startswith("(?m)") else "(?m)(?=" + heading.removeprefix("(?m)") + ")")
    rows = texts.select("name", F.posexplode(F.filter(parts, lambda p: p != "")).alias("chunk_no", "text"))
    headed = F.col("text").rlike(heading)
    title = F.when(headed, F.regexp_replace(F.regexp_extract("text", "^([^\n]*)", 1), r"^#+\s*", "")).otherwise(F.col("name"))
    return rows.select("name", F.col("chunk_no").cast("long").alias("chunk_no"), title.alias("title"), "text")


def index(chunk_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, term, tf) and (term, df) of ``chunk_id, title, text``."""
    words = T.tokens(F.concat_ws(" ", "title", "text"), T.SEARCH_STOP)
    tf = chunk_rows.select("chunk_id", F.explode(words).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    return tf, tf.groupBy("term").agg(F.count("*").alias("df"))


def scores(questions: DataFrame, chunk_rows: DataFrame, extra: int = 0) -> DataFrame:
    """(question_id, chunk_id, score) of every pair that shares a term or whose title and question contain one another.

    Terms are an equi-join; only documents' titles that are a prefix-free candidate by a shared first term can earn the bonus, which a
    title with no term in common with the question cannot.
    """
    tf, df = index(chunk_rows)
    n = chunk_rows.agg(F.count("*").alias("n_chunks"))
    q = questions.select("question_id", F.explode(F.array_distinct(T.tokens(F.col("question"), T.SEARCH_STOP))).alias("term"))
    idf = F.log((F.col("n_chunks") + 1) / (F.col("df") + 1)) + 1
    part = (1 + F.log(F.least("tf", F.lit(CAP)))) * idf
    hits = q.join(df, "term").join(tf, "term").join(F.broadcast(n))  # one row
    sums = hits.groupBy("question_id", "chunk_id").agg(F.sum(part).alias("score"))
    titles = chunk_rows.select("chunk_id", T.plain(F.col("title")).alias("t"))
    asked = questions.select("question_id", T.plain(F.col("question")).alias("x"))
    both = sums.join(titles, "chunk_id").join(asked, "question_id")
    bonus = F.when(F.contains("t", F.col("x")) | F.contains("x", F.col("t")), BONUS).otherwise(0.0)
    return both.select("question_id", "chunk_id", (F.col("score") + bonus).alias("score"))


def top(scored: DataFrame, k: int = TOP, digits: int = 6) -> DataFrame:
    """The best ``k`` chunks of each question, by rounded score then id."""
    s = scored.withColumn("score", F.round("score", digits))
    r = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))
    return s.withColumn("rank", r.cast("long")).where(F.col("rank") <= k)


def audit(ranked: DataFrame, expected: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: questions, pass rate (a right chunk within ``PASS_RANK``) and mean reciprocal rank; both are 1 without a case."""
    found = ranked.join(expected, ["question_id", "chunk_id"]).groupBy("question_id").agg(F.min("rank").alias("rank"))
    all_ = cases.select("question_id").distinct().join(found, "question_id", "left")
    one = lambda c: F.coalesce(F.round(c, 6), F.lit(1.0))
    return all_.agg(F.count("*").alias("n_questions"), one(F.avg((F.coalesce("rank", F.lit(99)) <= PASS_RANK).cast("double"))).alias("pass_rate"), one(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0)))).alias("mrr"))


def site_search(pages: DataFrame, query: str, k: int = 8) -> DataFrame:
    """``page_id, title, body``: 100 for the title, 70 for a title that starts with the query, else 15 for each part found and 25 for the phrase."""
    q = F.lit(query.lower())
    hay = F.lower(F.concat_ws(" ", "title", "body"))
    parts = sum((F.contains(hay, F.lit(p)).cast("int") * 15 for p in dict.fromkeys(query.lower().split())), F.lit(0))
    score = F.when(F.lower("title") == q, 100).when(F.lower("title").startswith(query.lower()), 70).otherwise(parts + F.contains(hay, q).cast("int") * 25)
    return pages.select("page_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "page_id").limit(k)


def evidence(refs: DataFrame, segments: DataFrame, limit: int = 2) -> DataFrame:
    """Of each node's segments the first ``limit``, a new document before a second piece of one."""
    rows = refs.distinct().join(segments, "segment_id")
    in_doc = F.row_number().over(Window.partitionBy("node_id", "document_id").orderBy("sequence_index", "segment_id"))
    placed = rows.withColumn("nth", in_doc)
    r = F.row_number().over(Window.partitionBy("node_id").orderBy("nth", "document_id", "sequence_index", "segment_id"))
    return placed.withColumn("rank", r.cast("long")).where(F.col("rank") <= limit).select("node_id", "segment_id", "document_id", "rank")


def pack_order(nodes: DataFrame) -> list:
    """The order of dossiers in a knowledge pack: current ones, authority, salience, title."""
    rank = F.when(F.col("authority") == "mixed", 0).when(F.col("authority") == "authored", 1).when(F.col("authority") == "conversation", 2).when(F.col("authority") == "chat", 3).otherwise(4)
    return [rank.asc(), F.desc("salience"), F.col("node_id").asc()]
