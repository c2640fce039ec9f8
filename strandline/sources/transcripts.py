"""Messenger transcripts: a line protocol with continuation lines, read as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

HEADER = r"^\[(\d{1,2}\.\d{1,2}\.\d{4}),? (\d{1,2}:\d{2}:\d{2})\] ([^:]+): (.*)$"
MARKS = "^[‎‏‪-‮]+"
#: Housekeeping lines of the messenger, by what they contain in lower case.
SYSTEM_LINES = ("zprávy a hovory jsou opatřené koncovým šifrováním", "vytvořil/a skupinu", "přidal/a vás", "změnil/a ikonu této skupiny")


def messages(lines: DataFrame, owners: tuple[str, ...], system_lines: tuple[str, ...] = SYSTEM_LINES) -> DataFrame:
    """``chat_id, line_no, line`` -> chat_id, ord, author, role, time_unix (ms, naive times as UTC), text.

    A line without a header belongs to the message before it; before the first header it is dropped. Blank lines are skipped.
    """
    line = F.regexp_replace("line", MARKS, "")
    kept = lines.select("chat_id", "line_no", line.alias("line")).where(T.js_trim(F.col("line")) != "")
    head = kept.withColumn("head", F.col("line").rlike(HEADER))
    w = Window.partitionBy("chat_id").orderBy("line_no")
    island = head.withColumn("ord", F.sum(F.col("head").cast("long")).over(w)).where("ord > 0")
    part = lambda k: F.regexp_extract("line", HEADER, k)
    rows = island.groupBy("chat_id", "ord").agg(
        F.max(F.when(F.col("head"), F.struct(part(1).alias("d"), part(2).alias("t"), T.js_trim(part(3)).alias("a"), part(4).alias("x")))).alias("h"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", T.js_trim(F.col("line")).alias("v"))))).alias("more"),
    )
    housekeeping = F.lit(False)
    for s in system_lines:
        housekeeping = housekeeping | F.contains(F.lower("h.x"), F.lit(s))
    role = F.when(housekeeping, "system").when(F.col("h.a").isin(*owners), "owner").otherwise("other")
    time = F.unix_millis(F.try_to_timestamp(F.concat_ws(" ", "h.d", "h.t"), F.lit("d.M.yyyy H:mm:ss")))
    text = F.array_join(F.concat(F.array(T.js_trim(F.col("h.x"))), F.transform("more", lambda m: m["v"])), "\n")
    return rows.select("chat_id", "ord", F.col("h.a").alias("author"), role.alias("role"), time.alias("time_unix"), text.alias("text"))


def chats(msgs: DataFrame) -> DataFrame:
    """Per chat: sorted participants, first and last timed message, counts by role."""
    timed = F.col("time_unix").isNotNull()
    return msgs.groupBy("chat_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("role") != "system", F.col("author")))).alias("participants"),
        F.min_by("ord", F.when(timed, F.struct("time_unix", "ord"))).alias("first_ord"), F.max_by("ord", F.when(timed, F.struct("time_unix", "ord"))).alias("last_ord"),
        F.count("*").alias("n_messages"), F.count_if(F.col("role") == "owner").alias("n_owner"), F.count_if(F.col("role") == "other").alias("n_other"), F.count_if(F.col("role") == "system").alias("n_system"),
    )


def focus_timeline(items: DataFrame, group: str, ord_col: str, focus: str, context: str, window: int = 1) -> DataFrame:
    """Focus items with the context around them, each context once, claimed by the first focus item that reaches it.

    ``focus`` and ``context`` are SQL predicates on the items. Returns the items' columns with focus_ord, side (-1, 0, 1) and pos, the
    place in the timeline. ``ord_col`` counts 0, 1, ... within the group.
    """
    base = items.withColumn("__f", F.expr(focus)).withColumn("__c", F.expr(context))
    own = base.where("__f").select("*", F.col(ord_col).alias("focus_ord"), F.lit(0).alias("side"))
    reach = base.where("__f").select(F.col(group).alias("__g"), F.col(ord_col).alias("focus_ord"), F.explode(F.array(*(F.lit(d) for d in range(-window, window + 1) if d))).alias("__d"))
    reach = reach.select("__g", "focus_ord", (F.col("focus_ord") + F.col("__d")).alias("__o"), F.when(F.col("__d") < 0, -1).otherwise(1).alias("side"))
    first = reach.groupBy("__g", "__o").agg(F.min(F.struct("focus_ord", "side")).alias("__m"))
    around = base.where("__c AND NOT __f").join(first, (F.col(group) == F.col("__g")) & (F.col(ord_col) == F.col("__o"))).select(*base.columns, F.col("__m.focus_ord").alias("focus_ord"), F.col("__m.side").alias("side"))
    pos = F.row_number().over(Window.partitionBy(group).orderBy("focus_ord", "side", ord_col))
    return own.unionByName(around).withColumn("pos", pos.cast("long")).drop("__f", "__c")
