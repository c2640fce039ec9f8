"""Best-fit packing by linear grouping: documents into as few sequences of at most ``CAPACITY`` tokens as possible.

Lengths are whole numbers up to the capacity, so the corpus enters planning as a histogram of at most ``CAPACITY`` cells; the
plan is made on the driver from that alone and costs the same for any number of documents.

1. Large lengths (over ``CAPACITY / SMALL_PART``, below the capacity) are sorted and split into ``GROUPS`` groups of equal cardinality;
   each is rounded up to its group's largest, which leaves few sizes.
2. Configurations (multisets of those sizes that fit) are optimised by column generation: a simplex over one row per size, priced
   by an exact knapsack, until no configuration saves more than ``TOLERANCE``. Whole multiples are taken.
3. Actual documents replace the rounded sizes, largest first within a group; a run of sequences with the same lengths stays one
   record, so the plan's size depends on the histogram only.
4. Small lengths, and the large ones that the multiples' fractions leave over, go best-fit, largest first, into the run with the least
   room that still takes them (the room that rounding up left), else into new sequences. What fractions leave is less than one
   sequence a group whatever the input's size.

Documents find their place by (length, rank): ranks within a length are numbered in salted parts, so that a length that a third of
all documents share is spread. A document longer than the capacity is cut; its first piece may be shorter. Null and empty texts
are one end id. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import encoder
from .common import bounded, cut, cut_python, need

CAPACITY, END_ID, SMALL_PART, GROUPS = 2048, 0, 8, 256
#: What a further configuration must save, as a part of a sequence, and the most knapsacks solved.
TOLERANCE, PRICINGS = 2e-4, 400


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and nth (its number in its task); ids stay in the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, nth = encoder(path), np.array([END_ID], np.uint32), 0
        for b in batches:
            rows = []
            for doc, ids in zip(b["doc_id"].astype("Int64"), enc.encode(list(b["text"])), strict=True):
                n = len(ids) + 1
                raw = memoryview(np.concatenate([ids, end]).astype("<u4").tobytes())
                first = n % capacity or capacity
                for k, (s, e) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n, capacity), n], strict=True)):
                    rows.append((doc, k, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), nth))
                    nth += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])
            yield out.astype({"doc_id": "Int64", "piece": "int32"})

    return need(docs, "doc_id", "text").mapInPandas(bounded(run, "text"), "doc_id long, piece int, start long, length long, ids_crc32 long, nth long")


def _knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``room``: the worth of the best multiset of sizes that fits, and the size put in last."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for k, (v, s) in enumerate(zip(values.tolist(), sizes.tolist(), strict=True)):
        if v > 1e-12:
            for _ in range(room // s):  # each pass allows one more copy
                gain = best[:-s] + v
                better = gain > best[s:] + 1e-12
                if not better.any():
                    break
                best[s:] = np.where(better, gain, best[s:])
                took[s:] = np.where(better, k, took[s:])
    return best, took


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination with row exchanges, in one thread."""
    m = len(matrix)
    both = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        top = k + int(np.abs(both[k:, k]).argmax())
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= np.multiply.outer(factor, both[k])
    return both[:, m:]


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(copies of each size, times): the whole part of the linear program's optimum, whose copies meet no more than the demand.

    Column generation: one row a size; the knapsack prices, for each size, the best configuration that holds it, and the simplex
    takes from that pool until none is worth more than a sequence by ``TOLERANCE``. Products are plain sums: at this size a threaded
    library's threads would mostly wait for cores that Spark's tasks hold.
    """
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = (inverse * demand).sum(1)
    for turn in range(PRICINGS):
        best, took = _knapsack(inverse.sum(0), sizes, room)
        if best[room] <= 1 + TOLERANCE:
            break
        pool = np.eye(m, dtype=np.int64)
        for k in range(m):
            at = room - int(sizes[k])
            while at > 0 and took[at] >= 0:
                pool[k, took[at]] += 1
                at -= int(sizes[took[at]])
        pool = np.unique(pool, axis=0).astype(float)
        for _ in range(3 * m):
            worth = (pool * inverse.sum(0)).sum(1)
            j = int(worth.argmax())
            if worth[j] <= 1 + TOLERANCE / 2:
                break
            step = (inverse * pool[j]).sum(1)
            up = step > 1e-9
            ratio = np.where(up, x / np.where(up, step, 1), np.inf)
            out = int(ratio.argmin())
            basis[:, out] = pool[j]
            x = np.maximum(x - ratio[out] * step, 0)
            x[out] = ratio[out]
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
        if turn % 10 == 9:  # against the drift of the updates
            inverse = _inverse(basis)
            x = np.maximum((inverse * demand).sum(1), 0)
    left, found = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        a = np.rint(basis[:, j]).astype(np.int64)
        times = min(int(x[j] + 1e-6), *(int(left[i] // a[i]) for i in np.flatnonzero(a)))
        if times > 0:
            left -= a * times
            found.append((a, times))
    return found


class _Runs:
    """Runs of sequences alike: room left -> [(count, [(length, first rank, copies, offset)])]."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at: list[list] = [[] for _ in range(capacity + 1)]
        self.rank: dict[int, int] = {}

    def ranks(self, length: int, n: int) -> int:
        first = self.rank.get(length, 0)
        self.rank[length] = first + n
        return first

    def add(self, count: int, items: list, room: int) -> None:
        self.at[room].append((count, items))

    @staticmethod
    def split(items: list, n: int) -> list:
        return [(length, rank + n * copies, copies, offset) for length, rank, copies, offset in items]

    def best_fit(self, length: int, n: int) -> None:
        room = length
        while n:
            while room <= self.capacity and not self.at[room]:
                room += 1
            if room > self.capacity:
                per = self.capacity // length
                self.add(max(1, n // per), [], self.capacity)
                room = self.capacity
            count, items = self.at[room].pop()
            copies = min(room // length, n)
            used = min(count, n // copies)
            if used < count:
                self.at[room].append((count - used, self.split(items, used)))
            rank = self.ranks(length, used * copies)
            self.add(used, [*items, (length, rank, copies, self.capacity - room)], room - copies * length)
            n -= used * copies
            room = length


def _grouped(runs: _Runs, lengths: np.ndarray, counts: np.ndarray, groups: int) -> dict[int, int]:
    """Linear grouping of these lengths: adds the configurations with their documents to ``runs``; returns what is left, by length."""
    big, many = lengths[::-1], counts[::-1]
    upto = np.cumsum(many)
    group = np.minimum((upto - 1) * groups // upto[-1], groups - 1)
    ids = np.unique(group)
    sizes = np.array([big[group == g].max() for g in ids])
    demand = np.array([many[group == g].sum() for g in ids])
    stock = [[[int(s), int(n)] for s, n in zip(big[group == g], many[group == g], strict=True)][::-1] for g in ids]
    for a, times in configurations(sizes, demand, runs.capacity):
        columns = []
        for i in (i for i in range(len(sizes)) for _ in range(a[i])):  # the next ``times`` documents of the group, largest first
            got, want = [], times
            while want:
                length, have = stock[i][-1]
                take = min(have, want)
                got.append((length, take))
                want -= take
                if take == have:
                    stock[i].pop()
                else:
                    stock[i][-1][1] -= take
            columns.append(got)
        ends = [np.cumsum([t for _, t in got]) for got in columns]
        edges = np.unique(np.concatenate([[0], *ends]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # sequences whose documents have the same lengths
            offset, items = 0, []
            for got, end in zip(columns, ends, strict=True):
                length = got[int(np.searchsorted(end, lo, "right"))][0]
                items.append((length, runs.ranks(length, hi - lo), 1, offset))
                offset += length
            runs.add(hi - lo, items, runs.capacity - offset)
    left: dict[int, int] = {}
    for cells in stock:
        for length, n in cells:
            left[length] = left.get(length, 0) + n
    return left


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, ranks, copies, first sequence, offset, grouped) sorted by length and rank, and the number of sequences.

    ``grouped`` is 1 where a configuration placed the documents and 0 where best-fit did.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    runs = _Runs(capacity)
    full, large = lengths == capacity, (lengths * SMALL_PART > capacity) & (lengths < capacity)
    rest = {n: c for n, c in histogram.items() if n * SMALL_PART <= capacity}
    if full.any():  # each fills a sequence
        runs.add(int(counts[full][0]), [(capacity, runs.ranks(capacity, int(counts[full][0])), 1, 0)], 0)
    if large.any():
        rest |= _grouped(runs, lengths[large], counts[large], groups)
    placed_by_groups = dict(runs.rank)
    for length, n in sorted(rest.items(), reverse=True):
        runs.best_fit(length, n)
    rows, sequence = [], 0
    for level in runs.at:
        for count, items in level:
            rows += [(length, rank, count * copies, copies, sequence, offset, int(rank < placed_by_groups.get(length, 0))) for length, rank, copies, offset in items]
            sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 7), sequence


def placed(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cuts`` (doc_id, piece, start, length, ids_crc32, nth; a written table) with sequence_id and offset."""
    spark = cuts.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = cuts.withColumn("salt", F.pmod("nth", F.lit(salts)))  # by place, not by content: repeated rows are spread too
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = cut(cells.select("length", "salt", "n", F.coalesce(ahead, F.lit(0)).alias("base")), "pack-cells")
    histogram = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, _ = plan(histogram, capacity)
    key = table[:, 0] << 48 | table[:, 1] if len(table) else np.zeros(0, np.int64)
    row = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "nth")) - 1
    ranked = salted.withColumn("row", row).join(base.select("length", "salt", "base"), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("row"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank, length = b["rank"].to_numpy(np.int64), b["length"].to_numpy(np.int64)
            at = np.searchsorted(key, length << 48 | rank, side="right") - 1
            t = table[at] if len(b) else np.zeros((0, 7), np.int64)
            inside = rank - t[:, 1]
            yield b[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=t[:, 4] + inside // np.maximum(t[:, 3], 1), offset=t[:, 5] + inside % np.maximum(t[:, 3], 1) * length)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return placed(cut_python(pieces(docs, path, capacity), "pieces"), capacity)


def op5_best_fit_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, packed; one row per piece."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
