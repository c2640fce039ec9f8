"""The engine's inputs over the driver's tables, and the same as SQL common table expressions.

Writings are documents (one paragraph a line, undated), conversations are conversations, and a user's events are a chat: purchases are
the owner's messages, errors housekeeping, all others the other side's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table; one that comes as fewer splits than there are cores (a single small file) is dealt over them before its texts are worked on."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df


def writings(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select(F.concat(F.lit("writing:"), F.col("doc_id").cast("string")).alias("document_id"), F.coalesce(T.first_line(F.col("text")), F.lit("")).alias("title"), F.col("text").alias("body"), F.lit(None).cast("long").alias("time_unix"))


def turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("conversation:"), F.col("conv_id").cast("string")).alias("conversation_id"), F.col("turn").cast("long").alias("ord"), "role", "text", F.lit(None).cast("long").alias("time_unix"))


def messages(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ord_ = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    role = F.when(F.col("event_type") == "purchase", "owner").when(F.col("event_type") == "error", "system").otherwise("other")
    return e.select(F.concat(F.lit("chat:"), F.col("user_id").cast("string")).alias("chat_id"), ord_.alias("ord"), role.alias("role"), F.concat_ws(" ", "event_type", "props").alias("text"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time_unix"))


def segments(spark, sf_dir) -> DataFrame:
    return corpus.writing_segments(writings(spark, sf_dir), r"\n").unionByName(corpus.turn_segments(turns(spark, sf_dir))).unionByName(corpus.message_segments(messages(spark, sf_dir)))


def documents(spark, sf_dir) -> DataFrame:
    w = writings(spark, sf_dir).select("document_id", "title")
    c = turns(spark, sf_dir).select(F.col("conversation_id").alias("document_id")).distinct().select("document_id", F.col("document_id").alias("title"))
    return w.unionByName(c)


#: name -> (what it needs, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "w_lines": ((), "SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL"),
    "w_seg": (("w_lines",), "SELECT 'writing:' || doc_id AS document_id, unnest(p) AS text, generate_subscripts(p, 1)::BIGINT AS sequence_index FROM (SELECT doc_id, CASE WHEN len(ls) > 1 THEN ls[2:] ELSE ls END AS p FROM w_lines)"),
    "c_seg": ((), "SELECT 'conversation:' || conv_id AS document_id, turn, role, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence_index FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''"),
    "msgs": ((), "SELECT 'chat:' || user_id AS chat_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, CASE event_type WHEN 'purchase' THEN 'owner' WHEN 'error' THEN 'system' ELSE 'other' END AS role, event_type || ' ' || props AS text, epoch_us(ts) // 1000 AS time_unix FROM events"),
    "m_seg": (("msgs",), "SELECT chat_id AS document_id, ord, role, text, time_unix, row_number() OVER (PARTITION BY chat_id ORDER BY ord) AS sequence_index FROM msgs WHERE role <> 'system'"),
    "segments": (
        ("w_seg", "c_seg", "m_seg"),
        """SELECT document_id || ':paragraph:' || sequence_index AS segment_id, document_id, 'writing' AS source_kind, 'primary' AS signal_kind, 'self' AS author_kind, sequence_index, NULL::BIGINT AS time_unix, 0 AS source_priority, text FROM w_seg
UNION ALL SELECT document_id || ':turn:' || turn, document_id, 'conversation', CASE role WHEN 'user' THEN 'primary' ELSE 'context' END, CASE role WHEN 'user' THEN 'self' ELSE role END, sequence_index, NULL, 1, text FROM c_seg
UNION ALL SELECT document_id || ':msg:' || ord, document_id, 'chat', CASE role WHEN 'owner' THEN 'primary' ELSE 'context' END, CASE role WHEN 'owner' THEN 'self' ELSE 'other_person' END, sequence_index, time_unix, 2, text FROM m_seg""",
    ),
}


def sql(query: str, *needs: str) -> str:
    """``query`` under the common table expressions it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + query if order else query


def words_sql(x: str, least: int = 3, stop: str | None = None) -> str:
    """DuckDB: label tokens of a text, in order."""
    cond = f"length(t) >= {least}" + (f" AND NOT list_contains({stop}, t)" if stop else "")
    return f"list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^a-z0-9]+'), lambda t: {cond})"


def slug_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def list_sql(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def jaccard_sql(a: str, b: str, empty: float = 1.0) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {union} = 0 THEN {empty} ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / {union} END)"
