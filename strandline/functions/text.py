"""Text kernel: column functions only, so every one stays inside Catalyst.

String order is binary; ``\\s`` is Unicode-wide as the trims need it; marks are folded by a Latin table built from Unicode's own
decompositions, which covers the scripts the corpus has.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold() -> tuple[str, str]:
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FROM, TO = _fold()

#: Words that carry no label meaning, for identity resolution.
MERGE_STOP = (
    "a aby ale ani as at bez by byt co cim do i ja je jsme jsou k kdyz ktery ma me mezi mi muze na nad ne nebo neni nez o od po pod pro proto se si tak "
    "take to tohle toto u uz v ve vsak vse vsichni z za ze the and for from into its of that this with"
).split()
#: Words that retrieval leaves out.
SEARCH_STOP = "a aby ale ani co do je jak jako jsou k ke kdy ktere kterou ma me mi na nad nebo o od po pod pro se si s ta tak to u ve v z za ze the of and is in for".split()


def js_trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Whitespace runs to one space, trimmed."""
    return js_trim(F.regexp_replace(x, r"(?U)\s+", " "))


def plain(x: Column) -> Column:
    """Lower case without marks; ASCII texts skip the table."""
    return F.lower(F.when(F.octet_length(x) == F.length(x), x).otherwise(F.translate(x, FROM, TO)))


def _capitals() -> tuple[str, str]:
    """Characters whose upper case is several, and their capital of one character; themselves where there is none."""
    many = [c for c in map(chr, range(0x110000)) if len(c.upper()) > 1]
    return "".join(many), "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in many)


MANY, CAPITAL = _capitals()


def capitalize(x: Column) -> Column:
    """With a capital first character, one for one: a sharp s gets its own capital, a ligature stays."""
    first = F.substring(x, 1, 1)
    up = F.upper(first)
    return F.concat(F.when(F.length(up) > 1, F.translate(first, MANY, CAPITAL)).otherwise(up), F.substr(x, F.lit(2)))


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(plain(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def count_words(x: Column) -> Column:
    t = js_trim(x)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+"))).cast("long")


def lines(x: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(x, "\r?\n"), js_trim), lambda v: v != "")


def first_line(x: Column) -> Column:
    return F.get(lines(x), F.lit(0))


def preview(x: Column, cap: int = 180) -> Column:
    flat = squeeze(x)
    return F.when(F.length(flat) <= cap, flat).otherwise(F.concat(F.substring(flat, 1, cap - 3), F.lit("...")))


def clip(x: Column, cap: int) -> Column:
    flat = squeeze(x)
    return F.when(F.length(flat) <= cap, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, cap - 1), r"(?U)\s+$", ""), F.lit("…")))


def tokens(x: Column, stop=MERGE_STOP, least: int = 3) -> Column:
    """Label tokens in order, repeats kept."""
    words = F.split(plain(x), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least)


def title_tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(slugify(x), "-"), lambda w: F.length(w) >= 2))


def keywords(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(plain(x), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)))


def token_estimate(x: Column, per: int = 4) -> Column:
    """Characters of the trimmed text by ``per``, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(js_trim(x)) / per)).cast("long")


def export_estimate(x: Column) -> Column:
    return F.ceil(F.length(x) / 3).cast("long")


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of two arrays as sets; ``empty`` if both have none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(float(empty))).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements by the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def signature(title: Column, key: Column, stop=MERGE_STOP) -> Column:
    """Blocking key: the first four title tokens (key tokens if there is none), sorted."""
    t = tokens(title, stop)
    return F.array_join(F.array_sort(F.slice(F.when(F.size(t) > 0, t).otherwise(tokens(key, stop)), 1, 4)), "-")


def relation_key(kind: Column, a: Column, b: Column) -> Column:
    """Symmetric relations order their ends, directed ones keep them."""
    symmetric = kind.isin("co_occurs", "semantic_related", "tensions_with", "context_split")
    return F.when(symmetric, F.concat_ws(":", kind, F.least(a, b), F.greatest(a, b))).otherwise(F.concat_ws(":", kind, a, b))


def date_of_name(name: Column) -> Column:
    """The date of a ``_MM_DD_YYYY`` suffix; null if there is none or it is no date."""
    p = r"_(\d{2})_(\d{2})_(\d{4})$"
    return F.when(name.rlike(p), F.try_to_date(F.concat_ws("-", F.regexp_extract(name, p, 3), F.regexp_extract(name, p, 1), F.regexp_extract(name, p, 2)), "yyyy-MM-dd"))


def label_of_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"_\d{2}_\d{2}_\d{4}$", ""), r"[-_\s]+$", "")


def stable_hash(*cols: Column) -> Column:
    """SHA-256 of the columns as one JSON record, in the order given."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def set_hash(items: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of the SHA-256 of a set's sorted members."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(items)), "\n"), 256), 1, digits)


def id_prefix(x: Column) -> Column:
    return F.substring_index(x, ":", 2)


def source_ref_key(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def before_context(x: Column, most: int = 2000) -> Column:
    """The end of the text before, with a mark where it was shortened."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.lit("[...]\n"), F.substring(x, -most, most)))


def after_context(x: Column, most: int = 2000) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most), F.lit("\n[...]")))


def clean_evidence(x: Column) -> Column:
    """Without asset tags, links to local files and lines that are left blank."""
    kept = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(x, r"\[(image|audio|video|asset)\]", ""), r"\[([^\]]*)\]\((?:sandbox:|file:|/)[^)]*\)", "$1"), "\n"), js_trim), lambda v: v != "")
    return F.array_join(F.transform(kept, lambda v: F.regexp_replace(v, r"[ \t]+", " ")), "\n")


def intro_prefix(x: Column, most: int = 320) -> Column:
    """What introduces a pasted text: up to the first blank line, line end or sentence end within bounds."""
    tidy = lambda c: js_trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    para, line = F.instr(x, "\n\n") - 1, F.instr(x, "\n") - 1
    head = F.substring(x, 1, most)
    last = F.length(F.regexp_extract(head, r"(?s)^(.*[.?!:]) ", 1)) - 1
    return (
        F.when(x == "", "")
        .when((para > 0) & (para <= 2 * most), tidy(F.substr(x, F.lit(1), para)))
        .when((line > 0) & (line <= most), tidy(F.substr(x, F.lit(1), line)))
        .when(last >= 40, tidy(F.substr(head, F.lit(1), last + 1)))
        .otherwise(tidy(head))
    )


#: The words that family clustering, review and frame alignment leave out.
FAMILY_STOP = [w for w in MERGE_STOP if w not in ("vsichni", "into", "its")]
ALIGN_STOP = [*FAMILY_STOP, "jako", "skrze", "vuci"]
#: Words that titles are compared without.
TITLE_STOP = "a an and as bez by do for i in is jako je k ke na nad nebo o od of po pod pro se s the to u ve vs v with z za ze".split()
