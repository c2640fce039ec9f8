"""Assistant conversations: active branch, content shapes, turn sanitiser, inclusion gate and work filter, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

PASTE_CHARS, STRUCTURED_CHARS, ACADEMIC_CHARS, HEAD_CHARS = 4000, 8000, 40000, 1600
SHORT_CONVERSATION = 10
#: Signals of pasted text, matched without case.
EXPLICIT = ("tady mas obsah souboru", "obsah souboru jako text", "jeste je tam soubor", "file contents?", "api reference", "zakaznicka app:", "partnerska app:", "funkcni popis", r"login\s*/\s*pristupy", "billing:")
TRANSPORT = ("dam ti sem", "ted ti sem dam", "jeste tam je", "tady to je", "posilam sem", "pockej na pokyn", "zatim nic nerikej")
OBJECTS = "souboru kapitolu clanku studii textu paperu api reference admin login billing backend utf8 json aplikace".split()
ACADEMIC = ("here we present", r"\bet al\.?\b", r"\(n.?=\s*\d+\)", r"\b\d+,\d+\b", r"\d+[–,-]\d+", "theory-neutral consortium")
INTRO = (r"nasel jsem tento clanek\s*:", "potrebuju vysvetlit nasledujici text", "o tomto clanku bych se dnes chtel bavit", "kolega mi poslal sv[uů]j text", "tady (?:autor|autorka) pise", "toto je vynatek z knihy", r"chatgpt\s*[rř]ekl\s*:", "tady je lepsi vysvetleni")
BODY_MARKER = r"toto jsou jejich terms\s*(?:&|and)\s*conditions\s*:"
PROMPTS = ("from now on you are going to act as a dan", "do anything now")
#: Work vocabulary by bucket, over text without marks. A ``*`` takes any word ending and ``|`` stands between words of one entry: the same
#: entries make Spark's patterns and DuckDB's, which write the ends of words differently.
WORK = {
    "system": [
        "aplikac*", "app", "projekt*", "backend*", "frontend*", "admin", "billing", "klient*", "registrac*", "login", "databaz*", "db",
        "endpoint*",
    ],
    "implementation": [
        "kod*", "code", "api", "json", "python", "typescript", "javascript", "flutter", "xcode", "swift", "skript*", "script*", "soubor*",
        "dokument*", "schema*", "enum", "class", "function", "return", "repo|repozitar*", "build", "deploy", "workflow",
    ],
    "intent": [
        "specifikac*", "analyz*", "algoritm*", "implement*", "prehled*", "funkcionalit*", "oprava|opravit|opraven*|opravy", "debug*", "bug*",
        "nasad*", "konfigurac*", "tabulk*", "pozadav*", "pravidl*",
    ],
}
STRONG = [
    "backend*", "frontend*", "endpoint*", "api", "json", "python", "typescript", "javascript", "flutter", "xcode", "databaz*", "db", "enum",
    "function", "repo|repozitar*", "deploy*", "login", "billing",
]
WORK_TURNS, WORK_CHARS = 6, 8000


def word_pattern(word: str) -> str:
    """An ASCII word, or one of several; ``*`` stands for any ending."""
    return r"(?<![A-Za-z0-9_])(?:" + word.replace("*", "[A-Za-z0-9_]*") + r")(?![A-Za-z0-9_])"


def _any(x: Column, patterns) -> Column:
    return x.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def _count(x: Column, patterns) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + x.rlike("(?iu)" + p).cast("int")
    return total


def role_of(author: Column, content_type: Column) -> Column:
    return F.when(content_type == "user_editable_context", "system").when(author.isin("user", "assistant", "tool", "system"), author).otherwise("unknown")


def part_text(part: Column) -> Column:
    """A content part, as JSON text: a string itself, an asset its placeholder, a record its text."""
    kind, body = F.get_json_object(part, "$.content_type"), F.coalesce(F.get_json_object(part, "$.text"), F.lit(""))
    asset = F.when(kind.contains("image"), "[image]").when(kind.contains("audio"), "[audio]").when(kind.contains("video"), "[video]").when(kind.contains("asset"), "[asset]")
    return F.when(part.startswith("{"), F.coalesce(asset, body)).otherwise(part)


def content_text(content: Column) -> Column:
    """The text of a message's content, as JSON text, for its shapes: parts, code, thoughts, recaps, quotes, browsing, context, pages."""
    kind = F.get_json_object(content, "$.content_type")
    get = lambda p: F.get_json_object(content, "$." + p)
    join = lambda items, sep: F.array_join(F.filter(items, lambda v: F.coalesce(T.js_trim(v) != "", F.lit(False))), sep)
    parts = join(F.transform(F.from_json(get("parts"), "array<string>"), part_text), "\n")
    thoughts = join(F.transform(F.from_json(get("thoughts"), "array<struct<summary: string, content: string>>"), lambda t: F.coalesce(F.when(T.js_trim(t["summary"]) != "", t["summary"]), t["content"])), "\n\n")
    both = lambda *ps: join(F.array(*(get(p) for p in ps)), "\n")
    return (
        F.when(kind.isin("text", "multimodal_text"), parts).when(kind == "code", get("text")).when(kind == "thoughts", thoughts).when(kind == "reasoning_recap", get("content"))
        .when(kind == "tether_quote", both("title", "text", "url")).when(kind == "tether_browsing_display", both("summary", "result")).when(kind == "user_editable_context", both("user_profile", "user_instructions"))
        .when(kind == "sonic_webpage", both("title", "snippet", "text")).otherwise(F.coalesce(get("text"), parts, F.lit("")))
    )


def active_chain(nodes: DataFrame) -> DataFrame:
    """conversation_id, node_id, ord of the branch from the current node up to the root, root first.

    ``nodes``: conversation_id, node_id, parent, current_node, time. The walk is a fold over one conversation's map, so it has at most as many
    steps as the conversation has nodes, and a cycle ends it at a node seen before; without a current node all nodes are taken by time.
    """
    per = nodes.groupBy("conversation_id").agg(F.first("current_node", True).alias("cur"), F.map_from_entries(F.collect_list(F.struct("node_id", F.coalesce("parent", F.lit(""))))).alias("up"), F.transform(F.array_sort(F.collect_list(F.struct(F.col("time").isNull().alias("z"), "time", "node_id"))), lambda x: x["node_id"]).alias("by_time"))
    step = lambda acc, _: F.when(F.map_contains_key("up", F.element_at(acc, -1)) & ~F.array_contains(acc, F.coalesce(F.try_element_at("up", F.element_at(acc, -1)), F.lit(""))), F.concat(acc, F.array(F.try_element_at("up", F.element_at(acc, -1))))).otherwise(acc)
    walk = F.aggregate(F.sequence(F.lit(1), F.size("up")), F.array("cur"), step)
    chain = F.when(F.col("cur").isNull(), F.col("by_time")).otherwise(F.reverse(F.filter(walk, lambda v: v != "")))
    return per.select("conversation_id", F.posexplode(chain).alias("ord", "node_id"))


def group_id(turns: DataFrame) -> DataFrame:
    """conversation_id, group_id: the template's id, else the first one along the chain."""
    found = F.min_by("message_group", F.when(F.col("message_group") != "", F.col("ord")))
    return turns.groupBy("conversation_id").agg(F.coalesce(F.first("template_id", True), found).alias("group_id"))


def sanitized(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Adds action (keep, trim, drop), clean and reason: one cascade of rules over signals computed once."""
    body = T.js_trim(F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\f", "\n"))
    df = turns.withColumn("__t", body).withColumn("__h", F.substring("__t", 1, HEAD_CHARS))
    t, h = F.col("__t"), F.col("__h")
    lines = F.filter(F.transform(F.split(t, "\n"), T.js_trim), lambda v: v != "")
    short = F.when(F.size(lines) == 0, 0.0).otherwise(F.size(F.filter(lines, lambda v: F.length(v) <= 80)) / F.size(lines))
    before = F.when(_any(t, [BODY_MARKER]), T.js_trim(F.regexp_replace(F.regexp_replace(F.substr(t, F.lit(1), F.regexp_instr(t, F.lit("(?iu)" + BODY_MARKER)) - 1), "[ \t]+", " "), "\n{3,}", "\n\n"))).otherwise("")
    df = df.withColumn("__n", F.size(lines)).withColumn("__s", short).withColumn("__b", before).withColumn("__i", T.intro_prefix(t))
    many = (F.regexp_count(t, F.lit("(?i)https?://")) >= 2) | (F.regexp_count(t, F.lit(r"(?m)^\s*[-*•]")) >= 6) | (F.regexp_count(t, F.lit(r"(?m):\s*$")) >= 6)
    structured = (F.length(t) >= STRUCTURED_CHARS) & (F.col("__n") >= 120) & (F.col("__s") >= 0.45) & many
    academic = (F.length(t) >= ACADEMIC_CHARS) & (_count(h, ACADEMIC) >= 2)
    lead = F.substring(t, 1, 160)
    heading = lead.rlike(r"^\s*\d+(?:[.-]\d+)+(?:\s+|$)") | lead.rlike(r"^\s*\d+\.\s*[A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ]") | lead.rlike(r"(?i)^\s*[IVXLC]+\.\s+")
    broken = F.regexp_count(t, F.lit(r"(?iu)[a-záčďéěíňóřšťúůýž]{2,}-\n[a-záčďéěíňóřšťúůýž]{2,}")) >= 2
    chapter = (F.length(t) >= STRUCTURED_CHARS) & heading & (academic | broken | (F.col("__s") >= 0.35))
    out = lambda action, clean, reason: F.struct(F.lit(action).alias("action"), clean.alias("clean"), F.lit(reason).cast("string").alias("reason"))
    intro = lambda reason: F.when(F.col("__i") != "", out("trim", F.col("__i"), reason)).otherwise(out("drop", F.lit(""), reason))
    none = F.lit("")
    verdict = (
        F.when(F.col(role) != "user", out("keep", t, None)).when(t == "", out("drop", none, "empty_user_turn")).when(F.length(t) < PASTE_CHARS, out("keep", t, None))
        .when(_any(h, PROMPTS), out("drop", none, "prompt_dump")).when(_any(h, EXPLICIT), intro("explicit_pasted_document"))
        .when(_any(h, TRANSPORT) & _any(h, OBJECTS), intro("transport_preface_plus_document_dump")).when(F.col("__b") != "", out("trim", F.col("__b"), "intro_before_external_body"))
        .when(_any(h, INTRO), intro("intro_plus_external_excerpt")).when(structured & (_count(h, OBJECTS) >= 2), out("drop", none, "structured_document_dump"))
        .when(academic, out("drop", none, "academic_abstract_dump")).when(chapter, out("drop", none, "chapter_or_ocr_excerpt_dump")).otherwise(out("keep", t, None))
    )
    return df.withColumn("__v", verdict).select(*turns.columns, "__v.action", "__v.clean", "__v.reason")


def kept_turns(turns: DataFrame) -> DataFrame:
    """Turns that survive, with their trimmed text; what was trimmed is judged once more."""
    first = sanitized(turns).where("action <> 'drop' AND clean <> ''").withColumn("text", F.col("clean")).select(*turns.columns)
    return sanitized(first).where("action <> 'drop'").select(*turns.columns)


def inclusion(turns: DataFrame, groups: DataFrame | None = None, short: int = SHORT_CONVERSATION) -> DataFrame:
    """conversation_id, n_turns, has_fence, include, reason."""
    per = turns.groupBy("conversation_id").agg(F.count("*").alias("n_turns"), F.coalesce(F.max((F.col("role") != "system") & F.contains("text", F.lit("```"))), F.lit(False)).alias("has_fence"))
    per = per.join(groups, "conversation_id", "left") if groups is not None else per.withColumn("group_id", F.lit(None).cast("string"))
    reason = F.when(F.coalesce(F.col("group_id"), F.lit("")) != "", "excluded_gizmo").when(F.col("n_turns") <= short, "excluded_null_gizmo_short").when(F.col("has_fence"), "excluded_null_gizmo_code").otherwise("null_gizmo_long_non_code")
    return per.select("conversation_id", "n_turns", "has_fence", (reason == "null_gizmo_long_non_code").alias("include"), reason.alias("reason"))


def work_score(conversations: DataFrame, vocabulary: dict[str, list[str]] = WORK, strong: list[str] = STRONG) -> DataFrame:
    """``conversation_id, title, body`` -> hits by bucket, score and exclude."""
    norm = T.plain(F.concat_ws("\n\n", "title", "body"))
    df = conversations.withColumn("__n", norm).withColumn("__t", T.plain(F.col("title")))
    hits = lambda x, words: sum((F.regexp_count(x, F.lit(word_pattern(w))) for w in words), F.lit(0))
    df = df.select("*", *(hits(F.col("__n"), ws).alias(f"{b}_hits") for b, ws in vocabulary.items()), sum((hits(F.col("__t"), ws) for ws in vocabulary.values()), F.lit(0)).alias("title_hits"), sum((F.col("__n").rlike(word_pattern(w)).cast("int") for w in strong), F.lit(0)).alias("strong"))
    per = [F.col(f"{b}_hits") for b in vocabulary]
    df = df.withColumn("buckets", sum(((c > 0).cast("int") for c in per), F.lit(0))).withColumn("hits", sum(per, F.lit(0)))
    exclude = (F.col("buckets") >= 2) & (F.col("hits") >= 5) & (F.col("strong") >= 2) & ((F.col("title_hits") >= 1) | (F.greatest(*per) >= 3))
    score = 3 * F.col("buckets") + F.col("hits") + F.least(F.col("title_hits"), F.lit(2))
    return df.select("conversation_id", *(F.col(f"{b}_hits") for b in vocabulary), "title_hits", "strong", "buckets", "hits", score.alias("score"), exclude.alias("exclude"))


def work_input(turns: DataFrame) -> DataFrame:
    """conversation_id, body: the first user turns, joined and cut."""
    w = Window.partitionBy("conversation_id").orderBy("ord")
    top = turns.where("role = 'user'").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= WORK_TURNS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n")
    return top.groupBy("conversation_id").agg(F.substring(joined, 1, WORK_CHARS).alias("body"))


def role_counts(turns: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("user", "assistant", "tool", "system", "unknown")]
    return turns.groupBy("conversation_id").agg(F.count("*").alias("n_turns"), *counts)
