"""What the training-data operators share: tables on shared storage, names that cannot clash, bounded batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import cut, shared_dir

__all__ = ["bounded", "cut", "cut_python", "fresh", "light", "need", "release", "row_key", "shared_dir", "table"]

#: The most that a side of a join may take to be broadcast.
LIGHT_BYTES = 32_000_000
#: Rows and characters that Python works on at once, and Spark's settings for the Arrow batches that they are cut from, with the most that they may be.
BATCH_ROWS, BATCH_CHARS = 500, 2_000_000
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_python(df: DataFrame, name: str, times: int = 1) -> DataFrame:
    """``cut`` of a table that Python workers make: Arrow batches are small (``times`` the usual) while it is written, and the session's settings are as before afterwards.

    A worker keeps the memory that its largest batch took, so batches of Spark's size would stay with an executor from stage to stage.
    """
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in ARROW}
    try:
        for k, v in ARROW.items():
            conf.set(k, str(times * v))
        return cut(df, name)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def light(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``df`` marked for broadcast if its rows, measured, take at most ``LIGHT_BYTES``; else as it is, for a shuffled join. ``df`` should be a written table."""
    took = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes).cast("long")).first()[0]
    return F.broadcast(df) if (took or 0) <= LIGHT_BYTES else df


def fresh(taken, *names: str) -> list[str]:
    """Column names like ``names`` that ``taken`` does not have (Spark's names ignore case)."""
    low = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out


def need(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that further ones cannot clash with an operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def row_key(id_col: Column, text_col: Column) -> Column:
    """A key of a document that is never null: its id with its text's hash. Repeated rows share it and are one document."""
    return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("-")), F.hex(F.xxhash64(text_col)), F.length(F.coalesce(text_col, F.lit(""))).cast("string"))


def bounded(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], text: str, rows: int = BATCH_ROWS, chars: int = BATCH_CHARS):
    """``run`` over slices of its batches of at most ``rows`` rows, and ``chars`` characters of column ``text`` or one row; at a task's end memory is given back."""

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            start, held = 0, 0
            for k, t in enumerate(b[text]):
                size = len(t) if t is not None else 0
                if k > start and (held + size > chars or k - start >= rows):
                    yield b.iloc[start:k].reset_index(drop=True)
                    start, held = k, 0
                held += size
            yield b.iloc[start:].reset_index(drop=True)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(slices(batches))
        release()

    return whole


def release() -> None:
    """Give what a worker has freed back to the system: workers outlive their tasks, and what they hold counts against the executor in every later stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's
        ctypes.CDLL("libc.so.6").malloc_trim(0)
