"""The unified corpus: three kinds of source as one table of segments, rolled up to documents and put in one chronology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .ranking import global_rank

PRIORITY = {"writing": 0, "conversation": 1, "chat": 2}
COLUMNS = ["segment_id", "document_id", "source_kind", "signal_kind", "author_kind", "sequence_index", "time_unix", "source_priority", "text"]


def _finish(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("source_kind", F.lit(kind)).withColumn("source_priority", F.lit(PRIORITY[kind])).select(*COLUMNS)


def paragraphs(body, title, split: str = r"\n\s*\n+"):
    """Trimmed paragraphs that are not blank; the first goes if it is the title and not all there is."""
    ps = F.filter(F.transform(F.split(F.regexp_replace(body, "\r\n", "\n"), split), T.js_trim), lambda p: p != "")
    drop = (F.size(ps) > 1) & (T.squeeze(F.get(ps, F.lit(0))) == T.squeeze(title))
    return F.when(drop, F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0)))).otherwise(ps)


def writing_segments(writings: DataFrame, split: str = r"\n\s*\n+") -> DataFrame:
    """``document_id, title, body, time_unix`` -> primary segments."""
    rows = writings.select("document_id", "time_unix", F.posexplode(paragraphs(F.col("body"), F.col("title"), split)).alias("p", "text"))
    ids = F.concat_ws(":", "document_id", F.lit("paragraph"), (F.col("p") + 1).cast("string"))
    return _finish(rows.select(ids.alias("segment_id"), "document_id", F.lit("primary").alias("signal_kind"), F.lit("self").alias("author_kind"), (F.col("p") + 1).cast("long").alias("sequence_index"), "time_unix", "text"), "writing")


def turn_segments(turns: DataFrame, assistant: bool = True, tool: bool = False) -> DataFrame:
    """``conversation_id, ord, role, text, time_unix``: user turns are primary, assistant and tool turns context if asked for; the place counts kept turns."""
    roles = ["user"] + ["assistant"] * assistant + ["tool"] * tool
    kept = turns.withColumn("text", T.js_trim(F.col("text"))).where(F.col("role").isin(*roles) & (F.col("text") != ""))
    user = F.col("role") == "user"
    seq = F.row_number().over(Window.partitionBy("conversation_id").orderBy("ord")).cast("long")
    rows = kept.select(F.concat_ws(":", "conversation_id", F.lit("turn"), F.col("ord").cast("string")).alias("segment_id"), F.col("conversation_id").alias("document_id"), F.when(user, "primary").otherwise("context").alias("signal_kind"), F.when(user, "self").otherwise(F.col("role")).alias("author_kind"), seq.alias("sequence_index"), "time_unix", "text")
    return _finish(rows, "conversation")


def message_segments(messages: DataFrame) -> DataFrame:
    """``chat_id, ord, role, text, time_unix``: the owner's messages are primary, others' context, housekeeping goes."""
    kept = messages.withColumn("text", T.js_trim(F.col("text"))).where("role <> 'system' AND text <> ''")
    owner = F.col("role") == "owner"
    seq = F.row_number().over(Window.partitionBy("chat_id").orderBy("ord")).cast("long")
    rows = kept.select(F.concat_ws(":", "chat_id", F.lit("msg"), F.col("ord").cast("string")).alias("segment_id"), F.col("chat_id").alias("document_id"), F.when(owner, "primary").otherwise("context").alias("signal_kind"), F.when(owner, "self").otherwise("other_person").alias("author_kind"), seq.alias("sequence_index"), "time_unix", "text")
    return _finish(rows, "chat")


def timeline(segments: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Adds chronology_index (time with nulls last, document, place, id) and the document's title, its id where there is none."""
    order = [F.col("time_unix").asc_nulls_last(), F.col("document_id").asc(), F.col("sequence_index").asc(), F.col("segment_id").asc()]
    ranked = global_rank(segments, order, "chronology_index")
    if documents is None:
        return ranked
    return ranked.join(documents.select("document_id", "title"), "document_id", "left").withColumn("title", F.coalesce("title", "document_id"))


def document_rollup(segments: DataFrame) -> DataFrame:
    """Per document: primary text, context text (null if there is none), and counts."""

    def joined(kind: str):
        rows = F.array_sort(F.collect_list(F.when(F.col("signal_kind") == kind, F.struct("sequence_index", "text"))))
        return F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n")

    agg = segments.groupBy("document_id", "source_kind").agg(
        joined("primary").alias("primary_text"), joined("context").alias("context_text"), F.count_if(F.col("signal_kind") == "primary").alias("n_primary"), F.count_if(F.col("signal_kind") == "context").alias("n_context"), F.min("time_unix").alias("time_unix")
    )
    return agg.withColumn("context_text", F.when(F.col("n_context") > 0, F.col("context_text")))


def corpus_stats(segments: DataFrame) -> DataFrame:
    """One row: documents and segments, in all, by signal and by kind."""
    of = lambda name, cond: F.count_if(cond).alias(name)
    kinds = [of(f"n_{k}", F.col("source_kind") == k) for k in PRIORITY]
    return segments.agg(F.count_distinct("document_id").alias("n_documents"), F.count("*").alias("n_segments"), of("n_primary", F.col("signal_kind") == "primary"), of("n_context", F.col("signal_kind") == "context"), *kinds)


def source_index(refs: DataFrame, segments: DataFrame) -> DataFrame:
    """Nodes by segment: ``node_id, segment_id`` refs joined to segments, both ways."""
    return refs.join(segments, "segment_id").groupBy("segment_id", "document_id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))


def neighbours(segments: DataFrame, cap: int = 2000) -> DataFrame:
    """Primary segments with the primary text before (its end) and after (its start) in the same document."""
    w = Window.partitionBy("document_id").orderBy("sequence_index")
    own = segments.where("signal_kind = 'primary'")
    return own.select("*", T.before_context(F.lag("text").over(w), cap).alias("before"), T.after_context(F.lead("text").over(w), cap).alias("after"))


def expanded_evidence(segments: DataFrame, base: int = 320, cap: int = 700, reach: int = 3) -> DataFrame:
    """Short segments are widened by neighbours of the same document, signal and author, nearest first, until ``cap`` characters."""
    w = Window.partitionBy("document_id", "signal_kind", "author_kind").orderBy("sequence_index")
    near = F.array(*(f(F.struct(F.col("sequence_index").alias("seq"), "text"), d).over(w) for d in range(1, reach + 1) for f in (F.lag, F.lead)))
    held = F.filter(near, lambda x: x.isNotNull())
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x["text"]))
    start = F.array(F.struct(F.col("sequence_index").alias("seq"), "text"))
    grown = F.aggregate(held, start, lambda a, x: F.when(size(a) + F.length(x["text"]) <= cap, F.concat(a, F.array(x))).otherwise(a))
    picked = F.when(F.length("text") < base, grown).otherwise(start)
    return segments.select("segment_id", F.transform(F.array_sort(picked), lambda x: x["seq"]).alias("places"), F.array_join(F.transform(F.array_sort(picked), lambda x: x["text"]), "\n").alias("evidence"))
