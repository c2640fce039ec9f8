"""The seam for a semantic model: batches of rows through a function of the user's, with retries, validation and repair one by one.

Off by default: the engine's own candidates, decisions and maps are deterministic rules. A provider is any picklable function from a list of
records to a list of records; it runs in Python workers over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Provider = Callable[[list[dict]], list[dict]]


class ProviderError(RuntimeError):
    """A failure with its kind: auth, quota, timeout or other."""

    def __init__(self, message: str):
        super().__init__(message)
        self.kind = failure_kind(message)


def failure_kind(message: str) -> str:
    low = message.lower()
    for kind, words in {"auth": ("unauthorized", "401", "login", "api key"), "quota": ("quota", "rate limit", "429"), "timeout": ("timed out", "timeout")}.items():
        if any(w in low for w in words):
            return kind
    return "other"


def call(provider: Provider, batch: list[dict], key: str, attempts: int = 2) -> list[dict]:
    """The batch's answers, one an item and in order. A timeout is tried again; wrong answers are asked for item by item."""

    def valid(asked: list[dict], got: list[dict]) -> bool:
        return [a[key] for a in asked] == [g.get(key) for g in got]

    for turn in range(attempts):
        try:
            got = provider(batch)
            break
        except Exception as e:
            kind = failure_kind(str(e))
            if kind != "timeout" or turn == attempts - 1:
                raise ProviderError(f"{kind}: {e}") from e
    if valid(batch, got):
        return got
    out = []
    for item in batch:
        one = provider([item])
        if not valid([item], one):
            raise ProviderError(f"no valid answer for {item[key]}")
        out += one
    return out


def through(rows: DataFrame, provider: Provider, key: str, schema: str, size: int = 32) -> DataFrame:
    """``rows`` through the provider in batches of ``size``; each answer has the item's ``key``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            items = b.to_dict("records")
            for k in range(0, len(items), size):
                yield pd.DataFrame(call(provider, items[k : k + size], key))

    return rows.mapInPandas(run, schema)
