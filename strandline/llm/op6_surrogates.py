"""Personal data replaced by keyed surrogates of the same type, gender, script and format, in SQL functions alone.

One pattern finds e-mail addresses, IPv4 addresses, IBANs, social security numbers, payment cards, phone numbers, hexadecimal secrets,
access keys, values assigned to a password or the like, and names (a title or a known given name before capitalised words). A document's
found names are then replaced wherever they stand alone in it. Each find becomes units: a name's words (given names with a gender, and
surnames) or the whole find. Units are compared in a canonical form (lower case; digits alone for numbers), so the same person, number
or address written differently is one entity everywhere, and a surname is the same with or without the given name.

A surrogate keeps its entity's format: letters become letters of the same script, digits digits, hexadecimal digits such; octets keep
their number of digits, cards keep the first digit and whether Luhn's sum holds, phones their country digit, addresses their top-level
domain. So a format is a row of places with radices, and its values can be counted and numbered. Names are made of syllables of the script with endings of
the gender, longer ones in later rounds. Case and punctuation come from each occurrence.

Distinctness is exact: different entities of a type get different surrogates, and none is a real entity of the corpus.

* Formats with room (four values or more for an entity) draw from SHA-256 of key, type, canonical form and a round number. Surrogates that
  are real, taken, or drawn twice (all but the first) are drawn again; each round settles half of the rest or more, and rounds go on
  until none is left.
* Formats without room number all their values, drop the real ones and deal the others to the entities, both in keyed order. Entities
  that find their format full get one of a format that is a place wider, and so on.

The key is the caller's; the query takes it from ``spark.strandline.pii.key`` and only for want of it uses a known one, which protects nobody.
Null texts stay null, with 0 entities. Repeated rows get equal texts. Documents without a find pass by unshuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, need, row_key

#: The setting that holds the key, and what tests and checks of synthetic tables run with.
KEY_SETTING, KNOWN_KEY = "spark.strandline.pii.key", "known"
#: Values that a format must have for each entity to be drawn from at random; values numbered in one row; parts of a ranking.
ROOM, STRETCH, BUCKETS = 4, 1 << 16, 256
#: Stands around finds; texts that hold it take a slower way.
MARK = "\x01"

#: Titles by the gender they tell, and frequent given names.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "господин", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita", "госпожа", "Κυρία"), "n": ("Dr", "Prof")}
GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Hans", "Peter", "Klaus", "Pierre", "Jean", "Carlos", "José", "Luis", "Иван", "Сергей", "Γιώργος"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Anna", "Maria", "Ursula", "Claudia", "Marie", "Sophie", "Carmen", "Lucía", "Анна", "Ольга", "Ελένη"),
}
#: Syllables and endings of made-up names, by script and gender.
SYLLABLES = {"latin": "ba be bo da de do fa fe ga ge ka ke ki la le lo ma me mi na ne no pa pe ra re ro sa se so ta te to va ve wi za", "cyrillic": "ба ве го да жа зо ка ле ми но па ра са те фо ха", "greek": "βα γε δι ζο θα κε λι μο να πε ρι σο τα φι"}
ENDINGS = {"latin": {"m": "rn us ld ron", "f": "ria lla na nia", "n": "len ris mil sen"}, "cyrillic": {"m": "р слав тин", "f": "ина ла рия", "n": "ен им ко"}, "greek": {"m": "νος ρης", "f": "νη ρια", "n": "λου δου"}}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_title = "|".join(t for ts in TITLES.values() for t in ts)
_given = "|".join(g for gs in GIVEN.values() for g in gs)
CAP = "\\p{Lu}\\p{L}+"
LABEL = "(?i:password|passwd|pwd|secret|api[_-]?key|token)[=:]"
KINDS = {
    "assigned": f"{LABEL}[A-Za-z0-9_+/-]{{6,}}",
    "access": "(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "email": "[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}",
    "ip": "(?<![\\d.])(?:\\d{1,3}\\.){3}\\d{1,3}(?![\\d]|\\.\\d)",
    "iban": "\\b[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\\b",
    "ssn": "(?<!\\d)\\d{3}-\\d{2}-\\d{4}(?!\\d)",
    "card": "(?<![\\d+])(?:\\d{4}[ -]?){3}\\d{1,7}(?!\\d)",
    "phone": "(?:\\+\\d{1,3}[ .-]?)?\\(?\\d{2,4}\\)?[ .-]?\\d{3}[ .-]?\\d{4}(?!\\d)",
    "secret": "(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])",
    "name": f"(?<!\\p{{L}})(?:(?:{_title})\\.? {CAP}(?: {CAP})?|(?:{_given}) {CAP})",
}
PATTERN = "|".join(f"(?:{KINDS[k]})" for k in ("assigned", "access", "email", "secret", "ip", "iban", "ssn", "card", "phone", "name"))
HINT = f"[0-9@]|AKIA|ASIA|{LABEL}|(?<!\\p{{L}})(?:{_title}|{_given})\\.? \\p{{Lu}}"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words: str) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words.split()) + ")"


def marked(text: str, pattern: str) -> str:
    """SQL: the text in pieces; those at odd places are the finds."""
    fast = f"split(regexp_replace({text}, {pattern}, '{MARK}$0{MARK}'), '{MARK}', -1)"
    slow = f"filter(flatten(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (a, b) -> array(a, b))), x -> x IS NOT NULL)"
    return f"IF(instr({text}, '{MARK}') = 0, {fast}, {slow})"


def units(found: DataFrame) -> DataFrame:
    """``found``: rid, pos, hit -> rid, pos, u (place in the hit), part, gap (what joins parts), kind (null: kept as it is), canon."""
    kind = "CASE " + " ".join(f"WHEN regexp_like(hit, {_sql('^(?:' + KINDS[k] + ')$')}) THEN '{k}'" for k in ("assigned", "access", "email", "secret", "ip", "iban", "ssn", "card", "phone")) + " ELSE 'name' END"
    rows = found.selectExpr("rid", "pos", "hit", f"{kind} AS kind0").selectExpr("*", f"CASE kind0 WHEN 'name' THEN split(hit, ' ') WHEN 'assigned' THEN array(regexp_extract(hit, {_sql('^' + LABEL)}, 0), regexp_replace(hit, {_sql('^' + LABEL)}, '')) ELSE array(hit) END AS parts")
    titled = f"regexp_like(parts[0], {_sql('^(?:' + _title + r')\.?$')})"
    told = "CASE " + " ".join(f"WHEN regexp_like(parts[0], {_sql('^(?:' + '|'.join(TITLES[g]) + r')\.?$')}) THEN '{g}'" for g in TITLES) + " END"
    rows = rows.selectExpr("*", f"{titled} AS titled", f"{told} AS told").selectExpr("*", "posexplode(parts) AS (u, part)")
    known = "CASE " + " ".join(f"WHEN part IN ({', '.join(_sql(n) for n in GIVEN[g])}) THEN '{g}'" for g in GIVEN) + " END"
    of_name = f"CASE WHEN size(parts) = 1 THEN 'alone' WHEN u = 0 AND titled THEN NULL WHEN u < size(parts) - 1 THEN concat('given:', coalesce({known}, told, 'n')) ELSE 'surname' END"
    rows = rows.selectExpr("rid", "pos", "u", "part", "IF(kind0 = 'name', ' ', '') AS gap", f"CASE WHEN kind0 = 'name' THEN {of_name} WHEN kind0 = 'assigned' AND u = 0 THEN NULL ELSE kind0 END AS kind")
    return rows.selectExpr("*", "CASE WHEN kind IN ('phone', 'card', 'ssn') THEN regexp_replace(part, '[^0-9]', '') WHEN kind = 'iban' THEN lower(replace(part, ' ', '')) ELSE lower(part) END AS canon")


def finds(docs: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Of documents (rid, text) with finds: rid and pieces (those at odd places are the finds), and their units."""
    first = docs.selectExpr("rid", f"{marked('text', _sql(PATTERN))} AS pieces").where("size(pieces) > 1").dropDuplicates(["rid"])
    first = cut(first, f"{tag}-first")
    hits = lambda df: df.selectExpr("rid", "posexplode(pieces) AS (pos, hit)").where("pos % 2 = 1")
    names = units(hits(first)).where("kind = 'surname' OR kind LIKE 'given:%'").groupBy("rid", "part").agg(F.min("kind").alias("known"))
    names = cut(names, f"{tag}-names")
    per_doc = names.groupBy("rid").agg(F.concat(F.lit("(?<!\\p{L})(?:"), F.array_join(F.sort_array(F.collect_list("part"), False), "|"), F.lit(")(?!\\p{L})")).alias("alone"))
    again = f"flatten(transform(pieces, (x, k) -> IF(k % 2 = 1, array(x), {marked('x', 'alone')})))"
    pieces = first.join(per_doc, "rid", "left").selectExpr("rid", f"IF(alone IS NULL, pieces, {again}) AS pieces")
    pieces = cut(pieces, f"{tag}-pieces")
    parts = units(hits(pieces)).join(names, ["rid", "part"], "left")
    return pieces, cut(parts.selectExpr("rid", "pos", "u", "part", "gap", "IF(kind = 'alone', known, kind) AS kind", "canon"), f"{tag}-units")


def _byte(i: str) -> str:
    """The i-th byte of the entity's stream in this round."""
    return f"cast(conv(substr(sha2(concat_ws('|', secret, kind, canon, round, cast({i} AS int) div 32), 256), 2 * (cast({i} AS int) % 32) + 1, 2), 16, 10) AS int)"


NUMBER = "kind IN ('phone', 'card', 'ssn')"
HEX = "(kind = 'secret' OR kind = 'assigned' AND regexp_like(form, '^[0-9a-f]+$'))"


def with_places(entities: DataFrame) -> DataFrame:
    """Adds, for all kinds but names, to kind and form (a value of the format): places (characters, or an address's octets), radices (1: the
    place stays as it is), shape (equal for forms of one format) and room (the format's values)."""
    fixed = "CASE kind WHEN 'email' THEN i > length(form) - instr(reverse(form), '.') WHEN 'iban' THEN i < 2 WHEN 'access' THEN i < 4 WHEN 'card' THEN i = 0 OR i = length(form) - 1 WHEN 'phone' THEN i = 0 WHEN 'ssn' THEN i = 0 ELSE false END"
    letter = " ".join(f"WHEN instr('{LETTERS[s]}', c) > 0 THEN {len(LETTERS[s])}" for s in LETTERS)
    radix = f"CASE WHEN kind = 'ip' THEN element_at(array(9, 90, 156), length(c)) WHEN {fixed} THEN 1 WHEN {HEX} THEN 16 WHEN {NUMBER} AND i = 1 THEN 9 WHEN c BETWEEN '0' AND '9' THEN 10 {letter} ELSE 1 END"
    df = entities.selectExpr("*", "IF(kind = 'ip', split(form, '\\\\.'), split(form, '')) AS places").selectExpr("*", f"transform(places, (c, i) -> {radix}) AS radices")
    shape = "concat_ws('|', transform(places, (c, i) -> IF(radices[i] = 1, concat('=', c), cast(radices[i] AS string))))"
    return df.selectExpr("*", f"IF(kind = 'card', concat({_luhn('form')}, {shape}), {shape}) AS shape", "aggregate(radices, 1D, (a, x) -> a * x) AS room")


def _luhn(s: str) -> str:
    digit = f"(ascii(substr({s}, j, 1)) - 48)"
    return f"aggregate(sequence(1, length({s})), 0, (a, j) -> a + IF((length({s}) - j) % 2 = 0, {digit}, (2 * {digit}) % 10 + cast(floor({digit} / 5) AS int))) % 10"


def spelled(df: DataFrame, number: str) -> DataFrame:
    """Adds surrogate: ``number`` (SQL of place i and radices[i]) is what stands at each place of kind, form, places, radices."""
    letter = " ".join(f"WHEN instr('{LETTERS[s]}', c) > 0 THEN substr('{LETTERS[s]}', v + 1, 1)" for s in LETTERS)
    at = f"CASE WHEN kind = 'ip' THEN cast(element_at(array(1, 10, 100), length(c)) + v AS string) WHEN radices[i] = 1 THEN c WHEN {HEX} THEN substr('0123456789abcdef', v + 1, 1) WHEN {NUMBER} AND i = 1 THEN cast(v + 1 AS string) WHEN c BETWEEN '0' AND '9' THEN cast(v AS string) {letter} ELSE c END"
    one = f"transform(array(cast({number} AS int)), v -> {at})[0]"
    df = df.selectExpr("*", f"array_join(transform(places, (c, i) -> {one}), IF(kind = 'ip', '.', '')) AS raw")
    base = "concat(substr(raw, 1, length(raw) - 1), '0')"
    checked = f"concat(substr(raw, 1, length(raw) - 1), cast(({_luhn('form')} - {_luhn(base)} + 10) % 10 AS string))"
    return df.selectExpr("*", f"IF(kind = 'card', {checked}, raw) AS surrogate").drop("raw")


def named(df: DataFrame) -> DataFrame:
    """Adds surrogate to names: kind, canon, round, secret."""
    script = "CASE WHEN regexp_like(canon, '\\\\p{IsCyrillic}') THEN 'cyrillic' WHEN regexp_like(canon, '\\\\p{IsGreek}') THEN 'greek' ELSE 'latin' END"
    pick = lambda words, i: f"element_at({words}, {_byte(i)} % size({words}) + 1)"
    sylls = "CASE script " + " ".join(f"WHEN '{s}' THEN {_array(SYLLABLES[s])}" for s in SYLLABLES) + " END"
    gender = "IF(kind LIKE 'given:%', substr(kind, 7), 'n')"
    endings = f"CASE concat(script, {gender}) " + " ".join(f"WHEN '{s}{g}' THEN {_array(ENDINGS[s][g])}" for s in ENDINGS for g in ENDINGS[s]) + " END"
    df = df.selectExpr("*", f"{script} AS script").selectExpr("*", f"{sylls} AS sylls", f"{endings} AS endings")
    syllables = "array_join(transform(sequence(1, 2 + int(kind = 'surname') + round div 4), i -> " + pick("sylls", "i") + "), '')"
    return df.selectExpr("*", f"concat({syllables}, {pick('endings', '0')}) AS surrogate")


def ranked(df: DataFrame, order: str, *by: str) -> DataFrame:
    """Adds nth (from 0) within ``by`` in the order of the hash ``order``: numbered in buckets of the hash, so that a large group is spread."""
    df = df.withColumn("bucket", F.pmod(F.xxhash64(order), F.lit(BUCKETS)))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = df.groupBy(*by, "bucket").agg(F.count("*").alias("n")).select(*by, "bucket", F.coalesce(before, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(order)) - 1
    return df.withColumn("inside", inside).join(sizes, [*by, "bucket"]).withColumn("nth", F.col("ahead") + F.col("inside")).drop("bucket", "inside", "ahead")


def dealt(entities: DataFrame, real: DataFrame, done: list[DataFrame], key: str, tag: str) -> DataFrame:
    """``entities`` (kind, canon, form, places, radices, shape, room): kind, canon, surrogate, each a free value of its form's format; without those that find it full."""
    keyed = lambda *c: F.sha2(F.concat_ws("|", F.lit(key), *c), 256)
    formats = entities.groupBy("kind", "shape").agg(F.min(F.struct("form", "places", "radices", "room")).alias("f")).select("kind", "shape", "f.*")
    some = formats.selectExpr("*", f"explode(sequence(0L, (cast(room AS bigint) - 1) div {STRETCH})) AS stretch").repartition(F.col("shape"), F.col("stretch"))
    values = some.selectExpr("*", f"explode(sequence(stretch * {STRETCH}, least(cast(room AS bigint), (stretch + 1) * {STRETCH}) - 1)) AS v")
    weight = "aggregate(slice(radices, 1, i), 1L, (a, x) -> a * x)"
    values = spelled(values, f"v div {weight} % radices[i]").select("kind", "shape", "surrogate")
    free = values.join(real.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
    for d in done:
        free = free.join(d.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
    free = ranked(free.withColumn("h", keyed("kind", "surrogate")), "h", "kind", "shape").select("kind", "shape", "nth", "surrogate")
    want = ranked(entities.select("kind", "shape", "canon").withColumn("h", keyed("kind", "canon")), "h", "kind", "shape").select("kind", "shape", "nth", "canon")
    return cut(want.join(free, ["kind", "shape", "nth"]).select("kind", "canon", "surrogate"), tag)


def surrogates(entities: DataFrame, key: str, tag: str) -> DataFrame:
    """kind, canon -> surrogate: distinct within a kind, and none a real entity of it."""
    real = cut(entities.where("kind IS NOT NULL").select("kind", "canon").distinct(), f"{tag}-entities")
    is_name = "(kind = 'surname' OR kind LIKE 'given:%')"
    shaped = cut(with_places(real.where(f"NOT {is_name}").withColumn("form", F.col("canon"))), f"{tag}-places")
    # counted per format with partial sums; only formats with few values for their entities are full ones
    full = cut(shaped.groupBy("kind", "shape").agg(F.count("*").alias("n"), F.max("room").alias("of")).where(f"n * {ROOM} > of").select("kind", "shape"), f"{tag}-full")
    columns = ["kind", "canon", "form", "places", "radices"]
    open_ = shaped.join(full, ["kind", "shape"], "left_anti").select(*columns).unionByName(real.where(is_name), allowMissingColumns=True)
    done, turn = [], 0
    while not open_.isEmpty():
        drawing = open_.withColumn("round", F.lit(turn)).withColumn("secret", F.lit(key))
        made = named(drawing.where(is_name)).select(*columns, "surrogate").unionByName(spelled(drawing.where(f"NOT {is_name}"), f"{_byte('i')} % radices[i]").select(*columns, "surrogate"))
        made = cut(made, f"{tag}-round{turn}")
        good = made.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        good = good.join(real.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        for d in done:
            good = good.join(d.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        done.append(cut(good.select("kind", "canon", "surrogate"), f"{tag}-good{turn}"))
        open_, turn = made.select(*columns).join(done[-1], ["kind", "canon"], "left_anti"), turn + 1
    tight = cut(shaped.join(full, ["kind", "shape"], "left_semi"), f"{tag}-tight")
    while not tight.isEmpty():
        got = dealt(tight, real, done, key, f"{tag}-dealt{turn}")
        done.append(got)
        wider = "CASE WHEN kind = 'ip' AND exists(places, c -> length(c) < 3) THEN transform(array(filter(sequence(0, size(places) - 1), i -> length(places[i]) < 3)[0]), w -> array_join(transform(places, (c, i) -> IF(i = w, concat('1', c), c)), '.'))[0] WHEN kind = 'ip' THEN concat(form, '.1') WHEN kind IN ('email', 'card') THEN concat(substr(form, 1, 1), IF(kind = 'card', '1', 'a'), substr(form, 2)) ELSE concat(form, '1') END"
        left = tight.join(got, ["kind", "canon"], "left_anti").selectExpr("kind", "canon", f"{wider} AS form")
        tight, turn = cut(with_places(left), f"{tag}-wider{turn}"), turn + 1
    return reduce(DataFrame.unionByName, done) if done else real.select("kind", "canon", F.lit("").alias("surrogate"))


def _dressed(part: str, kind: str, sur: str) -> str:
    """The surrogate in the case and punctuation of the occurrence; what a wider surrogate has more stands at the end."""
    chars = f"split({part}, '')"
    digits = f"aggregate({chars}, struct('' AS out, 1 AS k), (a, c) -> IF(c BETWEEN '0' AND '9', struct(concat(a.out, substr({sur}, a.k, 1)) AS out, a.k + 1 AS k), struct(concat(a.out, c) AS out, a.k AS k)), a -> concat(a.out, substr({sur}, a.k)))"
    spaced = f"aggregate({chars}, struct('' AS out, 1 AS k), (a, c) -> IF(c = ' ', struct(concat(a.out, c) AS out, a.k AS k), struct(concat(a.out, upper(substr({sur}, a.k, 1))) AS out, a.k + 1 AS k)), a -> concat(a.out, upper(substr({sur}, a.k))))"
    cased = f"concat(array_join(transform({chars}, (c, i) -> IF(c <> lower(c), upper(substr({sur}, i + 1, 1)), substr({sur}, i + 1, 1))), ''), substr({sur}, length({part}) + 1))"
    as_name = f"IF({part} = upper({part}), upper({sur}), initcap({sur}))"
    return f"CASE WHEN {kind} IS NULL THEN {part} WHEN {kind} IN ('phone', 'card', 'ssn') THEN {digits} WHEN {kind} = 'iban' THEN {spaced} WHEN {kind} = 'ip' THEN {sur} WHEN {kind} IN ('email', 'secret', 'assigned', 'access') THEN {cased} ELSE {as_name} END"


def pseudonymize(docs: DataFrame, key: str, tag: str = "pii") -> DataFrame:
    """doc_id, text with surrogates, n_entities (finds replaced) for every row."""
    keyed = need(docs, "doc_id", "text").withColumn("rid", row_key(F.col("doc_id"), F.col("text")))
    hinted = F.coalesce(F.expr(f"regexp_like(text, {_sql(HINT)})"), F.lit(False))
    pieces, parts = finds(keyed.where(hinted), tag)
    table = cut(surrogates(parts, key, tag), f"{tag}-table")
    swapped = parts.join(table, ["kind", "canon"], "left").selectExpr("rid", "pos", "u", "gap", _dressed("part", "kind", "surrogate") + " AS new")
    whole = swapped.groupBy("rid", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u", "gap", "new"))), lambda x: F.when(x["u"] == 0, x["new"]).otherwise(F.concat(x["gap"], x["new"]))), "").alias("new"))
    swaps = whole.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("news"))
    new = pieces.join(swaps, "rid").selectExpr("rid", "array_join(transform(pieces, (x, k) -> IF(k % 2 = 1, news[cast((k - 1) / 2 AS int)], x)), '') AS new", "size(news) AS n")
    changed = keyed.where(hinted).join(cut(new, f"{tag}-new"), "rid", "left").selectExpr("doc_id", "coalesce(new, text) AS text", "cast(coalesce(n, 0) AS bigint) AS n_entities")
    return changed.unionByName(keyed.where(~hinted).selectExpr("doc_id", "text", "0L AS n_entities"))


def op6_pii_surrogates(spark, sf_dir) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(KEY_SETTING, KNOWN_KEY), "op6")
