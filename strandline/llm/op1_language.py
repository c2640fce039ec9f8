"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters, lower-cased; a chain is a whole line, however long. A word's features are its
character n-grams of 2 to 4 with the word's ends as characters (so they hold prefixes and suffixes of up to three letters) and its
entry in a lexicon of the training words. Feature and transition weights are learned together by AdaGrad on the conditional
likelihood, with forward-backward for the gradient; training chains join stretches of documents in different languages, so
transitions see code-switching. Forward-backward then gives every word of a text a distribution over languages; a document's is
their mean.

Training reads text and lang alone, of rows with ``crc32(doc_id) mod 5 <> 0``, non-null lang and text, and at most ``MAX_CHARS``
characters: a hash deals each language's documents over ``PARTS`` parts, and of each part the ``PART_DOCS`` rows whose doc_id hashes
lowest are taken, ``DOC_WORDS`` words of each. That sample is bounded, rows and not documents being counted; prediction reads every
whole text.

``lang_pred`` is a learned language, or ``und`` with score 0 for null texts and texts without a letter. If there is no training row, all
are ``und``. Null doc_ids are not held out and not trained on. Repeated rows are predicted each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, cut, light, need

PARTS, PART_DOCS, MAX_CHARS, DOC_WORDS = 60, 10, 20_000, 150
GRAM_BITS, LEXICON, STRETCH, TRAIN_CHAIN = 17, 40_000, 15, 60
EPOCHS, BATCH, RATE, DECAY = 6, 256, 0.5, 1e-6
MEMO = 700_000
UNKNOWN = "und"
TOKEN = re.compile(r"[^\W\d_]+|\n")


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word index of each character n-gram."""
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = c == 32
    owner = np.cumsum(blank) - 1  # of a blank: the word after it
    buckets, owners = [], []
    for n in (2, 3, 4):
        m = len(c) - n + 1
        if m <= 0:
            continue
        h, ok = np.full(m, n, np.uint64), np.ones(m, bool)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ c[k : k + m]
            if 0 < k < n - 1:
                ok &= ~blank[k : k + m]
        if n == 2:
            ok &= ~(blank[:m] & blank[1 : 1 + m])
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)
        buckets.append(h[ok].astype(np.int64))
        owners.append(owner[:m][ok])
    return np.concatenate(buckets), np.concatenate(owners)


def forward_backward(emit: np.ndarray, first: np.ndarray, size: np.ndarray, begin: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words (rows of ``emit``), and the expected transitions. Chains are rows ``first .. first + size``."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    psi = np.exp(emit - emit.max(1, keepdims=True))
    alpha, beta = psi.copy(), np.ones_like(psi)
    step = np.exp(move - move.max())
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    alpha[first] *= np.exp(begin - begin.max())
    alpha[first] /= alpha[first].sum(1, keepdims=True)
    for t in range(1, len(live)):
        at = first[: live[t]] + t
        now = (alpha[at - 1] @ step) * psi[at]
        alpha[at] = now / now.sum(1, keepdims=True)
    for t in range(len(live) - 1, 0, -1):
        at = first[: live[t]] + t
        now = (psi[at] * beta[at]) @ step.T
        beta[at - 1] = now / now.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    later = np.ones(len(emit), bool)
    later[first] = False
    later = np.flatnonzero(later)
    right = psi[later] * beta[later]
    scale = np.einsum("ni,ij,nj->n", alpha[later - 1], step, right)
    pairs = step * (alpha[later - 1].T @ (right / scale[:, None]))
    return post, pairs


class Tagger:
    """The field's weights; emissions of words seen are remembered per worker (bounded)."""

    def __init__(self, labels: list[str], lexicon: list[str]):
        self.labels, n = labels, len(labels)
        self.lexicon = {w: k + 1 for k, w in enumerate(lexicon)}
        self.grams, self.entry = np.zeros((1 << GRAM_BITS, n), np.float32), np.zeros((len(lexicon) + 1, n), np.float32)
        self.begin, self.move = np.zeros(n, np.float32), np.zeros((n, n), np.float32)
        self.memo: dict[str, int] = {}
        self.table = np.zeros((1, n), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "table": np.zeros((1, len(self.labels)), np.float32)}

    def emissions(self, words: list[str]) -> np.ndarray:
        buckets, owners = gram_features(words)
        share = np.bincount(owners, minlength=len(words)).astype(np.float32)
        out = np.stack([np.bincount(owners, self.grams[buckets, k], len(words)) for k in range(len(self.labels))], 1).astype(np.float32)
        return out / np.sqrt(share)[:, None] + self.entry[[self.lexicon.get(w, 0) for w in words]]

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo, self.table = {}, self.table[:1]
        memo = self.memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if new:
            at = len(memo)
            memo.update(zip(new, range(at, at + len(new)), strict=True))
            rows = self.emissions(new)
            if at + len(new) > len(self.table):
                grown = np.zeros((2 * (at + len(new)), rows.shape[1]), np.float32)
                grown[:at] = self.table[:at]
                self.table = grown
            self.table[at : at + len(new)] = rows
        return self.table[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))]

    def posteriors(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All words of all texts, their posteriors, and the words in each text."""
        words: list[str] = []
        per_text, breaks = np.zeros(len(texts), np.int64), []
        for k, t in enumerate(texts):
            before = len(words)
            found = TOKEN.findall(t.lower()) if t else []
            if not any(c.isalpha() for w in found for c in w):
                found = []
            line = []
            breaks.append(before)
            if "\n" in found:
                start = 0
                for at in [i for i, w in enumerate(found) if w == "\n"]:
                    line = found[start:at]
                    words += line
                    breaks.append(len(words))
                    start = at + 1
                words += found[start:]
            else:
                words += found
            per_text[k] = len(words) - before
        if not words:
            return words, np.zeros((0, len(self.labels)), np.float32), per_text
        edges = np.unique(np.array([*breaks, len(words)]))
        post, _ = forward_backward(self.lookup(words), edges[:-1], np.diff(edges), self.begin, self.move)
        return words, post, per_text

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """(word, language) of each word of a text."""
        words, post, _ = self.posteriors([text])
        return [(w, self.labels[k]) for w, k in zip(words, post.argmax(1), strict=True)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its language, the language's mean share, its words, and how many of them are labelled otherwise."""
        label, score, other = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if not self.labels:
            return label, score, other, other
        _, post, per_text = self.posteriors(texts)
        full = np.flatnonzero(per_text)
        if len(full):
            first = (np.cumsum(per_text) - per_text)[full]
            mean = np.add.reduceat(post.astype(np.float64), first, axis=0) / per_text[full, None]
            for k, best, value in zip(full, mean.argmax(1), mean.max(1), strict=True):
                label[k], score[k] = self.labels[best], min(1.0, float(value))
            other[full] = np.add.reduceat(post.argmax(1) != np.repeat(mean.argmax(1), per_text[full]), first, dtype=np.int64)
        return label, score, per_text, other


def fit(rows: list[tuple[str, str]]) -> Tagger:
    """Learn from (text, lang); the same rows in the same order give the same weights."""
    labels = sorted({lang for _, lang in rows})
    code = {x: k for k, x in enumerate(labels)}
    rng = np.random.default_rng(7)
    stretches, seen = [], Counter()
    for text, lang in rows:
        words = [w for w in TOKEN.findall(text.lower()) if w != "\n"]
        if len(words) > DOC_WORDS:
            at = int(rng.integers(0, len(words) - DOC_WORDS + 1))
            words = words[at : at + DOC_WORDS]
        seen.update(words)
        stretches += [(words[i : i + STRETCH], code[lang]) for i in range(0, len(words), STRETCH)]
    lexicon = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n > 1]
    model = Tagger(labels, lexicon)
    if len(labels) < 2 or not stretches:
        return model
    names = {w: k for k, w in enumerate(seen)}
    known = list(names)
    buckets, owners = gram_features(known)
    order = np.argsort(owners, kind="stable")
    buckets, share = buckets[order], np.bincount(owners, minlength=len(known))
    first = np.cumsum(share) - share
    entry = np.array([model.lexicon.get(w, 0) for w in known])
    n = len(labels)
    sums = [np.full_like(x, 1e-2) for x in (model.grams, model.entry, model.begin, model.move)]

    def update(value: np.ndarray, grad: np.ndarray, total: np.ndarray) -> None:
        total += grad * grad
        value -= RATE * grad / np.sqrt(total)

    for epoch in range(EPOCHS):
        chains, chain, size = [], [], 0
        for k in rng.permutation(len(stretches)):
            chain.append(stretches[k])
            size += len(stretches[k][0])
            if size >= TRAIN_CHAIN or epoch == 0 and size >= STRETCH:  # single languages first
                chains.append(chain)
                chain, size = [], 0
        for b in range(0, len(chains), BATCH):
            part = chains[b : b + BATCH]
            at = np.array([names[w] for c in part for ws, _ in c for w in ws])
            gold = np.array([y for c in part for ws, y in c for _ in ws])
            lens = np.array([sum(len(ws) for ws, _ in c) for c in part])
            own, back = np.unique(at, return_inverse=True)
            many = share[own]
            ends = np.cumsum(many)
            feats = buckets[np.repeat(first[own] - (ends - many), many) + np.arange(ends[-1])]
            weight = (1 / np.sqrt(many)).astype(np.float32)
            emit = np.add.reduceat(model.grams[feats], ends - many, axis=0) * weight[:, None] + model.entry[entry[own]]
            begin = np.cumsum(lens) - lens
            post, pairs = forward_backward(emit[back], begin, lens, model.begin, model.move)
            grad = post.copy()
            grad[np.arange(len(gold)), gold] -= 1
            per_word = np.stack([np.bincount(back, grad[:, k], len(own)) for k in range(n)], 1) / len(part)
            later = np.ones(len(gold), bool)
            later[begin] = False
            later = np.flatnonzero(later)
            np.subtract.at(pairs, (gold[later - 1], gold[later]), 1)
            spread = np.repeat(per_word * weight[:, None], many, axis=0)
            cells = np.unique(feats)
            where = np.searchsorted(cells, feats)
            g = np.stack([np.bincount(where, spread[:, k], len(cells)) for k in range(n)], 1).astype(np.float32) + DECAY * model.grams[cells]
            sums[0][cells] += g * g
            model.grams[cells] -= RATE * g / np.sqrt(sums[0][cells])
            lex = np.zeros_like(model.entry)
            np.add.at(lex, entry[own], per_word)
            lex[0] = 0
            update(model.entry, lex, sums[1])
            start = post[begin].sum(0) - np.bincount(gold[begin], minlength=n)
            update(model.begin, (start / len(part)).astype(np.float32), sums[2])
            update(model.move, (pairs / len(part)).astype(np.float32), sums[3])
    return model


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    usable = f"doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND length(text) <= {MAX_CHARS} AND crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0"
    rows = need(docs, "doc_id", "lang", "text").where(usable).withColumn("h", F.xxhash64("text"))
    dealt = rows.select("doc_id", "lang", "h", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.xxhash64("doc_id"), "doc_id", "h"))  # Spark keeps each task's first ones before it shuffles
    taken = cut(dealt.withColumn("r", rank).where(f"r <= {PART_DOCS}").select("doc_id", "lang", "h").distinct(), "training")
    found = rows.join(light(taken, 60), ["doc_id", "lang", "h"]).dropDuplicates(["doc_id", "lang", "h"])
    return [(r["text"], r["lang"]) for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "h").collect()]


def identify(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_other (words of another language) for every row; one pass over whole texts, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            label, score, words, other = model.predict(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "lang_pred": label, "score": score, "n_words": words, "n_other": other})

    return need(docs, "doc_id", "text").mapInPandas(bounded(run, "text", 500), "doc_id long, lang_pred string, score double, n_words long, n_other long")


def op1_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(training_rows(docs)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_words", "n_other")
