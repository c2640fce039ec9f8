"""Greedy sequential batches under a count and a token budget.

The running sum resets at every batch, so a plain window cannot say where batches start. Narrow rows (an index and a size) are folded
in chronological order. Where a corpus has groups that may be batched apart (documents, sources), ``by`` makes each group a
fold of its own, which is the form for large corpora; one group's fold holds its rows' sizes alone, never their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SIZE, BUDGET, OVERHEAD = 32, 8000, 40


def items(segments: DataFrame) -> DataFrame:
    """Adds tokens: the text's estimate and the overhead of an item."""
    return segments.withColumn("tokens", T.token_estimate(F.col("text")) + OVERHEAD)


def starts(tokens: np.ndarray, size: int = SIZE, budget: int = BUDGET) -> np.ndarray:
    """The batch of each item: a batch closes when it is full or the next item would pass the budget; one that alone passes it stands alone."""
    out, batch, count, used = np.zeros(len(tokens), np.int64), 0, 0, 0
    for k, t in enumerate(tokens.tolist()):
        if count and (count >= size or used + t > budget):
            batch, count, used = batch + 1, 0, 0
        out[k] = batch
        count, used = count + 1, used + t
    return out


def batches(rows: DataFrame, by: list[str], order: str, size: int = SIZE, budget: int = BUDGET) -> DataFrame:
    """``rows`` (by..., order, tokens) -> batch_no from 0 in each group. Groups are folded in sorted Arrow batches, so a long one streams."""
    keys = [*by, order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys) + ", tokens long, batch_no long"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, count, used = None, 0, 0, 0
        for b in it:
            got = np.zeros(len(b), np.int64)
            for k, (g, t) in enumerate(zip(b[by].itertuples(index=False, name=None), b["tokens"].tolist(), strict=True)):
                if g != key:
                    key, batch, count, used = g, 0, 0, 0
                elif count and (count >= size or used + t > budget):
                    batch, count, used = batch + 1, 0, 0
                got[k] = batch
                count, used = count + 1, used + t
            yield b.assign(batch_no=got)

    narrow = rows.select(*keys, F.col("tokens").cast("long").alias("tokens"))
    dealt = narrow.repartition(*by).sortWithinPartitions(*by, order)
    return dealt.mapInPandas(run, schema)


def batch_sizes(batched: DataFrame, by: list[str]) -> DataFrame:
    return batched.groupBy(*by, "batch_no").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"))
