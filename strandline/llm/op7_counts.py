"""Token counts without token ids: byte-pair merging on a linked list, the lowest-rank adjacent pair popped from a heap.

The model is a sentencepiece BPE file with an identity normaliser, a space in front of each text, spaces as U+2581 and
byte fallback. A piece's rank is minus its score. Initial symbols are a text's characters; a merge joins two neighbours
whose string is a piece; the count is the initial symbols minus the merges, where a character that ends up alone and is
no piece counts as its UTF-8 bytes.

Merging never crosses two characters that stand side by side in no piece, so a text is cut there and each distinct cut
is counted once per worker (a bounded memo). This is exact: merges in different cuts do not touch each other.

Null and empty texts have no token. Repeated rows are counted each. Any length of text or word works: the heap makes a
word of n symbols cost n log n.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

SPACE = "▁"
LIMIT = 4096
#: Entries of a worker's memo before it starts anew.
MEMO = 400_000
#: Longer cuts are counted without being remembered.
MEMO_CHARS = 64


class PairCounter:
    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.memo: dict[str, int] = {}
        self.words: dict[str, int] = {}
        after: dict[str, set[str]] = {}
        for piece in self.rank:
            for a, b in zip(piece, piece[1:], strict=False):
                after.setdefault(a, set()).add(b)
        self.after = after
        #: whether U+2581 follows another character inside some piece; if not, each run of spaces starts a word
        self.spaces_lead = not any(SPACE in b for a, b in after.items() if a != SPACE)

    def merge(self, text: str) -> int:
        """Tokens of one cut."""
        rank, n = self.rank, len(text)
        if n == 1 or text in rank and n == 2:
            return 1 if text in rank else len(text.encode())
        sym = list(text)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, text[i : i + 2]) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] is None or j >= n or sym[i] + sym[j] != pair or len(sym[i]) + len(sym[j]) != len(pair):
                continue
            sym[i], sym[j] = pair, None
            left -= 1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := rank.get(pair + sym[k])) is not None:
                    heapq.heappush(heap, (r, i, pair + sym[k]))
            h = prv[i]
            if h >= 0 and (r := rank.get(sym[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, sym[h] + pair))
        return left + sum(len(s.encode()) - 1 for s in sym if s is not None and len(s) == 1 and s not in rank)

    def word(self, word: str) -> int:
        """Tokens of a stretch that starts with a space; cut where no piece has the two characters side by side."""
        after, none = self.after, ()
        total, start = 0, 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i] not in after.get(word[i - 1], none):
                part = word[start:i]
                got = self.memo.get(part)
                if got is None:
                    got = self.merge(part)
                    if len(part) <= MEMO_CHARS:
                        if len(self.memo) >= MEMO:
                            self.memo.clear()
                        self.memo[part] = got
                total += got
                start = i
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.spaces_lead:
            return self.word(text)
        known, total = self.words, 0
        for word in re.findall(SPACE + "+[^" + SPACE + "]*", text):
            got = known.get(word)
            if got is None:
                got = self.word(word)
                if len(word) <= MEMO_CHARS:
                    if len(known) >= MEMO:
                        known.clear()
                    known[word] = got
            total += got
        return total


@lru_cache(maxsize=2)
def counter(model_path: str) -> PairCounter:
    return PairCounter(model_path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; one pass, no shuffle."""
    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = counter(model_path)
        for batch in texts:
            yield pd.Series([model.count(t) for t in batch], dtype="int64")

    text = F.coalesce("text", F.lit(""))
    rows = need(docs, "doc_id", "text").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
