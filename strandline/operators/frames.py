"""Document frames: assignment of segments, contiguous runs, nearest frames, alignment of frames across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..plans.storage import cut
from .graph import connected

ROLE_WEIGHT = {"main_claim": 3.0, "revision_branch": 2.5, "question": 2.0, "tension": 2.0}


def role_weight(role):
    out = F.lit(1.0)
    for name, w in ROLE_WEIGHT.items():
        out = F.when(role == name, w).otherwise(out)
    return out


def first_claims(listed: DataFrame) -> DataFrame:
    """``document_id, frame_idx, pos``: each position belongs to the earliest frame that lists it."""
    return listed.groupBy("document_id", "pos").agg(F.min("frame_idx").alias("frame_idx"))


def longest_runs(listed: DataFrame, by: list[str]) -> DataFrame:
    """The longest run of successive positions of each group; of equally long ones the earliest."""
    w = Window.partitionBy(*by).orderBy("pos")
    isl = listed.select(*by, "pos").distinct().withColumn("isl", F.col("pos") - F.row_number().over(w))
    runs = isl.groupBy(*by, "isl").agg(F.count("*").alias("n"), F.min("pos").alias("start"))
    best = F.max_by(F.struct("start", "n"), F.struct("n", -F.col("start")))
    return runs.groupBy(*by).agg(best.alias("r")).select(*by, "r.start", (F.col("r.start") + F.col("r.n") - 1).alias("end"), "r.n")


def contiguous(listed: DataFrame, by: list[str]) -> DataFrame:
    return listed.groupBy(*by).agg((F.max("pos") - F.min("pos") + 1 == F.count_distinct("pos")).alias("contiguous"), F.count_distinct("pos").alias("n"))


def attach_orphans(assigned: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions without a frame go to the nearest frame's range in the document; ties to the earliest frame. Only documents with frames.

    A free position meets the ranges of its own document's frames (a handful, however long the document), found by an equi-join; nothing
    is compared across documents.
    """
    ranges = assigned.groupBy("document_id", "frame_idx").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    free = positions.join(assigned.select("document_id", "pos"), ["document_id", "pos"], "left_anti")
    dist = F.when(F.col("pos") < F.col("lo"), F.col("lo") - F.col("pos")).when(F.col("pos") > F.col("hi"), F.col("pos") - F.col("hi")).otherwise(0)
    near = free.join(ranges, "document_id").withColumn("d", dist)
    return near.groupBy("document_id", "pos").agg(F.min(F.struct("d", "frame_idx"))["frame_idx"].alias("frame_idx"))


def materialize(listed: DataFrame, positions: DataFrame) -> DataFrame:
    """(document_id, pos, frame_idx, how): listed positions by first claim, orphans by nearness, documents without a frame as one frame 0."""
    known = listed.join(positions.select("document_id", "pos").distinct(), ["document_id", "pos"], "left_semi")
    first = first_claims(known).withColumn("how", F.lit("listed"))
    orphans = attach_orphans(first, positions).withColumn("how", F.lit("nearest"))
    bare = positions.join(first.select("document_id").distinct(), "document_id", "left_anti").select("document_id", "pos", F.lit(0).alias("frame_idx"), F.lit("fallback").alias("how"))
    return first.select("document_id", "pos", "frame_idx", "how").unionByName(orphans).unionByName(bare)


def scopes(placed: DataFrame) -> DataFrame:
    """Per frame: size, range, and whether it covers its document (all positions but one at most)."""
    n = placed.groupBy("document_id").agg(F.count("*").alias("n_document"))
    per = placed.groupBy("document_id", "frame_idx").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return per.join(n, "document_id").select("document_id", "frame_idx", "n", "lo", "hi", F.when(F.col("n") >= F.col("n_document") - 1, "document").otherwise("section").alias("scope"))


def suppressed(subframes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Frames whose subframes only mirror paragraphs: three positions or more, two subframes or more, coverage and singletons of .67 or more."""
    per = subframes.groupBy("document_id", "frame_idx", "sub_idx").agg(F.count_distinct("pos").alias("k"))
    agg = per.groupBy("document_id", "frame_idx").agg(F.count("*").alias("subs"), F.count_if(F.col("k") == 1).alias("single"))
    cover = subframes.groupBy("document_id", "frame_idx").agg(F.count_distinct("pos").alias("covered"))
    j = agg.join(cover, ["document_id", "frame_idx"]).join(sizes.select("document_id", "frame_idx", "n"), ["document_id", "frame_idx"])
    return j.where((F.col("n") >= 3) & (F.col("subs") >= 2) & (F.col("covered") / F.col("n") >= 0.67) & (F.col("single") / F.col("subs") >= 0.67)).select("document_id", "frame_idx")


def anchor_tokens(texts: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent tokens of each group's texts, ties by token."""
    n = texts.select(*by, F.explode(T.tokens(F.col("text"), T.ALIGN_STOP)).alias("t")).groupBy(*by, "t").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "t"))
    top = n.withColumn("r", r).where(F.col("r") <= k)
    return top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("anchors"))


def anchor_nodes(members: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` nodes of a frame with most weighted support (``frame_id, node_id, role, n``)."""
    s = members.groupBy("frame_id", "node_id").agg(F.sum(F.col("n") * role_weight(F.col("role"))).alias("support"))
    r = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("support"), "node_id"))
    return s.withColumn("r", r).where(F.col("r") <= k).select("frame_id", "node_id", "support")


def _may_reach(a: str, b: str, threshold: float, bits: str = ""):
    """Whether two token sets may have a Jaccard similarity of ``threshold``, by their sizes and one bit a token: bits in which they differ are tokens that one lacks."""
    n = F.col("n" + a) + F.col("n" + b)
    need = F.ceil(n * (threshold / (1 + threshold)) - 1e-9)
    a, b = (bits + x[-1] if bits else x for x in (a, b))
    return n - F.bit_count(F.col("b" + a).bitwiseXOR(F.col("b" + b))) >= 2 * need


#: Members of a class that are listed in one row.
LISTED = 1000


def _classes(frames: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames with the same nodes, label tokens and anchors as one class: their sets (c, k, n, nodes, anchored, lt, at and bits), and their members (c, frame_id, document_id). Written.

    Nodes are numbers, in ascending order of how many classes have them. Frames without a document pair with none and are left out.
    """
    m = members.groupBy("frame_id", "node_id").agg(F.bool_or("anchor").alias("anchor"))
    sets = m.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "anchor"))).alias("nodes"))
    unique = lambda c: F.array_sort(F.array_distinct(c))
    f = frames.where("document_id IS NOT NULL").join(sets, "frame_id").select("frame_id", "document_id", "nodes", unique(T.tokens(F.col("label"), T.ALIGN_STOP)).alias("lt"), unique(F.col("anchors")).alias("at"))
    f = cut(f.withColumn("like", F.unhex(F.md5(F.to_json(F.struct("nodes", "lt", "at"))))).withColumn("rid", F.monotonically_increasing_id()), "frames")
    first = lambda c: F.first(c).alias(c)
    classes = cut(f.groupBy("like").agg(F.min("rid").alias("c"), F.count("*").alias("k"), first("nodes"), first("lt"), first("at")), "frame-classes")
    own = cut(f.select("like", "frame_id", "document_id").join(classes.select("like", "c"), "like").select("c", "frame_id", "document_id"), "class-members")

    rows = classes.select("c", F.explode("nodes").alias("node")).select("c", "node.node_id", "node.anchor")
    numbers = cut(rows.groupBy("node_id").agg(F.count("*").alias("p")).withColumn("i", F.monotonically_increasing_id()), "node-numbers")
    listed = rows.join(numbers, "node_id").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("p", "i", "anchor"))).alias("ns"))
    bits = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, t: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))))
    ids = lambda c: F.transform(c, lambda x: x["i"])
    s = listed.select("c", F.size("ns").alias("n"), ids(F.col("ns")).alias("nodes"), ids(F.filter("ns", lambda x: x["anchor"])).alias("anchored")).join(classes.select("c", "k", "lt", "at"), "c")
    sizes = {"nl": F.size("lt"), "na": F.size("at"), "bn": bits("nodes"), "ba": bits("anchored"), "bl": bits("lt"), "bt": bits("at")}
    return cut(s.withColumns(sizes), "class-sets"), own


def _near_classes(sets: DataFrame) -> DataFrame:
    """(c1, c2) of different classes that may belong together; written.

    The class of fewer nodes shares half of them, so one of its ``n - ceil(n / 2) + 1`` rarest: those alone meet the nodes of all others. Places and bits
    bound what two classes can share, and must allow one rule at least, before a pair leaves the join.
    """
    cols = ["c", "n", "bn", "ba", "nl", "bl", "na", "bt"]
    rows = sets.select(*cols, F.posexplode("nodes").alias("pos", "node"))
    side = lambda s, df: df.select("node", *(F.col(c).alias(c + s) for c in [*cols, "pos"]))
    x, y = side("1", rows.where("pos <= n - ceil(n / 2)")), side("2", rows)
    smaller = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("c1") < F.col("c2")))
    most = F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"), F.col("n1") - F.bit_count(F.col("bn1").bitwiseAND(F.bitwise_not("bn2"))))
    one = (F.col("ba1").bitwiseAND(F.col("ba2")) != 0) & F.coalesce(_may_reach("a1", "a2", 0.14, "t"), F.lit(False))
    two = (most >= 2) & F.coalesce(_may_reach("l1", "l2", 0.16), F.lit(False))
    return cut(x.join(y, "node").where(smaller & (2 * most >= F.col("n1")) & (one | two)).select("c1", "c2").distinct(), "class-near")


def _alike(sets: DataFrame) -> DataFrame:
    """(c1, c2, shared) of classes whose frames belong together, c1 < c2, and c1 = c2 of classes with several; written. A class that pairs with any pairs with itself."""
    side = lambda s: sets.select(*(F.col(c).alias(c + s) for c in ("c", "n", "nodes", "anchored", "lt", "at")))
    p = _near_classes(sets).join(side("1"), "c1").join(side("2"), "c2").withColumn("shared", F.size(F.array_intersect("nodes1", "nodes2")).cast("long"))
    one = F.arrays_overlap("anchored1", "anchored2") & (T.jaccard(F.col("at1"), F.col("at2")) >= 0.14)
    two = (F.col("shared") >= 2) & (T.jaccard(F.col("lt1"), F.col("lt2")) >= 0.16)
    hits = p.where((F.col("shared") / F.least("n1", "n2") >= 0.5) & (one | two)).select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2"), "shared")
    own = sets.where("k > 1 AND (size(anchored) > 0 AND at IS NOT NULL OR n >= 2 AND lt IS NOT NULL)").select(F.col("c").alias("c1"), F.col("c").alias("c2"), F.col("n").cast("long").alias("shared"))
    return cut(hits.unionByName(own), "class-pairs")


def frame_pairs(frames: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, shared) of frames of different documents that belong together. ``frames``: frame_id, document_id, label, anchors; ``members``: frame_id, node_id, anchor (boolean).

    Classes of frames alike are compared; their members are listed, in parts of ``LISTED``, and meet where the result is made, so no pair of frames is shuffled.
    """
    sets, own = _classes(frames, members)
    hits = _alike(sets)
    k = sets.select("c", "k")
    pairs = hits.join(k.select(F.col("c").alias("c1"), F.col("k").alias("k1")), "c1").join(k.select(F.col("c").alias("c2"), F.col("k").alias("k2")), "c2").agg(F.sum(F.col("k1") * F.col("k2"))).first()[0] or 0
    part = ((F.row_number().over(Window.partitionBy("c").orderBy("frame_id")) - 1) / LISTED).cast("int")
    lists = cut(own.withColumn("part", part).groupBy("c", "part").agg(F.collect_list(F.struct("frame_id", "document_id")).alias("fs")), "class-lists")
    ends = lambda s: lists.select(*(F.col(c).alias(c + s) for c in lists.columns))
    met = hits.join(ends("1"), "c1").join(ends("2"), "c2").where("c1 < c2 OR part1 <= part2")
    met = met.repartition(max(frames.sparkSession.sparkContext.defaultParallelism, min(2000, pairs // 200_000)), "c1", "part1", "c2", "part2")
    j = met.select("c1", "c2", "part1", "part2", "shared", "fs2", F.explode("fs1").alias("x")).select("*", F.explode("fs2").alias("y"))
    j = j.where("x.document_id <> y.document_id AND (c1 < c2 OR part1 < part2 OR x.frame_id < y.frame_id)")
    return j.select(F.least("x.frame_id", "y.frame_id").alias("a"), F.greatest("x.frame_id", "y.frame_id").alias("b"), "shared")


def aligned_families(frames: DataFrame, members: DataFrame) -> DataFrame:
    """``frame_families`` of the pairs that ``frame_pairs`` finds, by classes, without making these pairs.

    All frames of two classes that belong together are in one family unless both classes have one and the same document only: one of them has two documents or they have
    different ones, and a class with two documents is linked within itself. Cohesion counts a pair of classes as often as it has frames of different documents.
    """
    sets, own = _classes(frames, members)
    hits = _alike(sets)
    per = cut(own.groupBy("c").agg(F.count("*").alias("k"), F.min("document_id").alias("lo"), F.max("document_id").alias("hi"), F.min("frame_id").alias("low")), "class-documents")
    ends = lambda s: per.select(*(F.col(c).alias(c + s) for c in ("c", "k", "lo", "hi")))
    linked = hits.join(ends("1"), "c1").join(ends("2"), "c2").where("least(lo1, lo2) <> greatest(hi1, hi2)")
    linked = cut(linked.select("c1", "c2", "shared", "k1", "k2"), "class-links")
    within = own.groupBy("document_id", "c").agg(F.count("*").alias("m"))
    x, y = (within.select("document_id", F.col("c").alias("c" + s), F.col("m").alias("m" + s)) for s in "12")
    same = x.join(y, "document_id").where("c1 <= c2").groupBy("c1", "c2").agg(F.sum(F.col("m1") * F.col("m2")).alias("same"))
    times = F.col("k1") * F.col("k2") - F.coalesce("same", F.lit(0))  # of a class with itself each pair is counted twice here already
    sums = linked.join(same, ["c1", "c2"], "left").select(F.col("c1").alias("c"), (F.col("shared") * times * F.when(F.col("c1") == F.col("c2"), 1).otherwise(2)).alias("cohesion"))
    c = cut(connected(linked, "c1", "c2").select(F.col("node").alias("c"), "root"), "class-components")
    totals = c.join(sums.groupBy("c").agg(F.sum("cohesion").alias("cohesion")), "c", "left").join(per.select("c", "k", "low"), "c")
    totals = totals.groupBy("root").agg(F.min("low").alias("family"), F.sum("k").alias("size"), F.coalesce(F.sum("cohesion"), F.lit(0)).alias("cohesion"))
    return own.join(c.join(totals, "root"), "c").select("frame_id", "family", "size", "cohesion")


def frame_families(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """(frame_id, family, size) of frames that aligned pairs connect; cohesion counts shared nodes, each pair both ways."""
    pairs = cut(pairs, "frame-pairs")  # read by the components and by the sums
    c = connected(pairs, "a", "b").select(F.col("node").alias("frame_id"), F.col("root").alias("family"))
    size = c.groupBy("family").agg(F.count("*").alias("size"))
    inner = pairs.join(c.withColumnRenamed("frame_id", "a"), "a").groupBy("family").agg((2 * F.sum("shared")).alias("cohesion"))
    return c.join(size, "family").join(inner, "family", "left").select("frame_id", "family", "size", F.coalesce("cohesion", F.lit(0)).alias("cohesion"))
