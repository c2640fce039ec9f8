"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A block holds whole documents in ascending doc_id order. Its layout (little-endian): magic ``SLT1``; counts of documents
and tokens (u32); bytes of the index; the index (zlib: doc_ids as i64, null flags as u8, token counts as u32); one control byte
per four tokens, two bits each, giving the bytes of a token less one; then the tokens' low bytes, without gaps. What is coded is a token's rank
by corpus frequency, so the most frequent 256 take one byte. The ranks' ids are a table of at most the vocabulary's size,
stored once beside the blocks.

Files are Parquet tables of blocks on shared storage (executors have no other common file system), one file for each range of
doc_id; ``part`` and ``block`` give the order. Decoding looks up each control byte in tables of lengths and byte positions.

Null and empty texts have the end id alone. Null doc_ids come first. Repeated rows are stored as often as they occur, ties in
the order of their tokens' checksum. A text's length is bounded by memory only: a block is closed once it has
``BLOCK_TOKENS``, but a document is never split.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import bounded, cut_python, need

MAGIC, END_ID, BLOCK_TOKENS = b"SLT1", 0, 1 << 18
HEAD = struct.Struct("<4sIII")

#: For each control byte: the four lengths, their sum, and for each of the 16 target bytes its source (NONE where it has none).
NONE = 99
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
TOTALS = LENGTHS.sum(1)
_first = np.cumsum(LENGTHS, 1) - LENGTHS
SOURCES = np.where(np.arange(4)[None, None] < LENGTHS[:, :, None], _first[:, :, None] + np.arange(4)[None, None], NONE).reshape(256, 16).astype(np.int32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    v = values.astype("<u4")
    extra = (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    quads = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    quads[: len(v)] = extra
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    most = int(extra.max(initial=0)) + 1
    raw = v.astype("<u2").view(np.uint8).reshape(-1, 2) if most <= 2 else v.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(raw.shape[1]) <= extra[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers of ``pack``: every control byte selects its rows of the tables."""
    first = (np.cumsum(TOTALS[control]) - TOTALS[control]).astype(np.int32)
    narrow = not (control & 0xAA).any()  # two bytes at most
    sources = SOURCES.reshape(256, 4, 4)[:, :, : 2 if narrow else 4].reshape(256, -1)
    padded = np.concatenate([data, np.zeros(NONE + 17, np.uint8)])  # absent bytes are read from behind the end
    absent = len(data) + 16
    where = np.where(sources < NONE, sources, absent)[control]
    where = np.minimum(where + np.where(where < absent, first[:, None], 0), absent)
    return padded[where].reshape(-1).view("<u2" if narrow else "<u4")[:n].astype(np.uint32)


#: Distinct pre-tokens that a worker remembers here, where no other operator's memory stands beside.
MEMO = 600_000


def write_block(ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    index = zlib.compress(ids.astype("<i8").tobytes() + null.astype("u1").tobytes() + counts.astype("<u4").tobytes(), 1)
    return HEAD.pack(MAGIC, len(ids), len(ranks), len(index)) + index + b"".join(pack(ranks))


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, null flags, token counts, ranks."""
    magic, docs, tokens, size = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    index = zlib.decompress(block[HEAD.size : HEAD.size + size])
    at, quads = HEAD.size + size, -(-tokens // 4)
    ids, null = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "u1", docs, 8 * docs)
    ranks = unpack(np.frombuffer(block, np.uint8, quads, at), np.frombuffer(block, np.uint8, offset=at + quads), tokens)
    return ids, null, np.frombuffer(index, "<u4", docs, 9 * docs), ranks


def width(path: str) -> str:
    return "<u2" if encoder(path).lib.get_vocab_size() <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, crc (of u32 ids), ids (u16 where the vocabulary allows, else u32; the end id last)."""
    kind = width(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, stop = encoder(path, MEMO), np.array([END_ID], "<u4").tobytes(), np.array([END_ID], kind).tobytes()
        for b in batches:
            ids = enc.encode(list(b["text"]))
            crc = [zlib.crc32(end, zlib.crc32(x.astype("<u4").tobytes())) for x in ids]
            raw = [x.astype(kind).tobytes() + stop for x in ids]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": [len(x) + 1 for x in ids], "crc": crc, "ids": raw})

    return need(docs, "doc_id", "text").mapInPandas(bounded(run, "text", 3000, 12_000_000), "doc_id long, n_tokens long, crc long, ids binary")


def frequencies(tokens: DataFrame, kind: str) -> np.ndarray:
    """Ids by falling corpus frequency, ties by id. Each task sends one count per id it saw: at most the vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.int64)
        for b in batches:
            if len(b):
                got = np.bincount(np.frombuffer(b"".join(b["ids"]), kind))
                wide = np.zeros(max(len(got), len(seen)), np.int64)
                wide[: len(seen)] += seen
                wide[: len(got)] += got
                seen = wide
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"id": at, "n": seen[at]})

    rows = tokens.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_ids(tokens: DataFrame, by_rank: np.ndarray, kind: str, tag: str = "token-blocks") -> DataFrame:
    """The blocks' table, written: part, block, n_docs, n_tokens, ahead (the part's tokens before the block), payload."""
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    unit = np.dtype(kind).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, held, size, ahead = TaskContext.get().partitionId(), 0, [], 0, 0

        def close() -> pd.DataFrame:
            ids = np.array([0 if pd.isna(d) else d for d, _ in held], np.int64)
            null = np.array([pd.isna(d) for d, _ in held], bool)
            ranks = rank_of[np.frombuffer(b"".join(x for _, x in held), kind)]
            payload = write_block(ids, null, np.array([len(x) // unit for _, x in held]), ranks)
            return pd.DataFrame({"part": [part], "block": [block], "n_docs": [len(held)], "n_tokens": [len(ranks)], "ahead": [ahead], "payload": [payload]})

        for b in batches:
            for doc, raw in zip(b["doc_id"].astype("Int64"), b["ids"], strict=True):
                held.append((doc, raw))
                size += len(raw) // unit
                if size >= BLOCK_TOKENS:
                    yield close()
                    block, held, size, ahead = block + 1, [], 0, ahead + size
        if held:
            yield close()

    dealt = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("crc")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc")
    return cut_python(dealt.select("doc_id", "ids").mapInPandas(run, "part int, block int, n_docs int, n_tokens long, ahead long, payload binary"), tag, 4)


def read_ids(blocks: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """Per document, from the blocks: doc_id, start, n_tokens, ids_crc32. Only one total per file comes to the driver."""
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = dict(zip((p for p, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, ahead, payload in zip(b["part"], b["ahead"], b["payload"], strict=True):
                ids, null, counts, ranks = read_block(payload)
                raw = memoryview(by_rank[ranks].astype("<u4").tobytes())
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64").copy() if not null.any() else pd.array([None if z else i for i, z in zip(ids, null, strict=True)], "Int64"), "start": before[part] + ahead + starts, "n_tokens": counts.astype(np.int64), "ids_crc32": crc})

    return blocks.select("part", "ahead", "payload").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_ids(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens, kind = cut_python(tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), "tokens", 6), width(path)
    by_rank = frequencies(tokens, kind)
    return read_ids(write_ids(tokens, by_rank, kind), by_rank)
