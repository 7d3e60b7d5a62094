"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a linear classifier on hashed byte trigrams separates the
languages with a 1 from those with a 0. A text goes to the codeword with the smallest loss, each bit
weighted by how well its classifier does; a close runner-up marks the text as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import id_and_text

BUCKETS = 1 << 14
#: Labelled rows learned from, at most about so many; a fixed hash picks them.
TRAIN_ROWS = 60_000
#: Difference of softened probabilities below which a text is called ambiguous.
MARGIN = 0.2
#: Trigrams from which more text adds no more certainty.
ENOUGH = 48

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
for _c in range(26):
    _PLAIN[65 + _c] = _PLAIN[97 + _c] = 97 + _c


def trigram_buckets(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased words, each word between blanks."""
    plain = _PLAIN[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    plain = plain[np.r_[True, (plain[1:] != 32) | (plain[:-1] != 32)]].astype(np.uint32)
    code = plain[:-2] << np.uint32(16) | plain[1:-1] << np.uint32(8) | plain[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(18)


def codewords(n: int) -> np.ndarray:
    """(n, bits) matrix of -1 and 1: all splits of few languages, else the best of seeded random codes."""
    if n <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.float32).T.reshape(n, -1)
    bits, best, distance = int(np.ceil(15 * np.log2(n))), None, -1
    for seed in range(64):
        code = np.where(np.random.default_rng(seed).random((n, bits)) < 0.5, -1, 1).astype(np.float32)
        agree = code @ code.T - 2 * bits * np.eye(n)
        columns = np.abs(code.sum(axis=0)).max() < n  # every bit separates something
        if columns and bits - agree.max() > distance:
            best, distance = code, bits - agree.max()
    return best


class CodeModel:
    """``languages``, their ``code``, and per bit the ``weights`` of trigrams and the ``trust``."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages)) if len(self.languages) > 1 else np.zeros((len(self.languages), 0), np.float32)
        shares = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in self.languages]).reshape(-1, BUCKETS)
        weights = []
        for bit in self.code.T:
            weights.append(np.log(shares[bit > 0].mean(axis=0)) - np.log(shares[bit < 0].mean(axis=0)))
        self.weights = np.array(weights, np.float32).reshape(-1, BUCKETS)
        # Expected margin of a language's own trigrams on the right side of each bit, the worst language.
        reach = np.einsum("lb,lk,bk->bl", self.code, shares, self.weights) if weights else np.zeros((0, 1))
        self.trust = np.clip(reach.min(axis=1), 0.05, None) / max(1e-9, float(np.clip(reach.min(axis=1), 0.05, None).mean() if weights else 1))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        buckets = trigram_buckets(text)
        if not len(buckets):
            return "und", 0.0, False
        counts = np.bincount(buckets, minlength=BUCKETS) if len(buckets) > 512 else None
        if counts is not None:
            used = np.flatnonzero(counts)
            mean = (self.weights[:, used] @ counts[used].astype(np.float32)) / len(buckets)
        else:
            mean = self.weights[:, buckets].mean(axis=1)
        margins = self.code * (mean * min(len(buckets), ENOUGH))
        losses = (np.logaddexp(0, -margins) * self.trust).sum(axis=1) / self.trust.sum()
        chance = np.exp(-2 * (losses - losses.min()))
        chance /= chance.sum()
        order = np.lexsort((np.arange(len(chance)), -chance))
        return self.languages[order[0]], float(chance[order[0]]), bool(chance[order[0]] - chance[order[1]] < MARGIN)


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> CodeModel:
    """Model from (text, lang) rows; only the trigram counts of each language reach the driver."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    if n > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS))
                seen = np.bincount(trigram_buckets(text), minlength=BUCKETS)
                own += seen / max(1, seen.sum())  # a long text counts as much as a short one
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(own[used])], names=["lang", "bucket", "n"]
            )

    cells = rows.select("text", F.col("lang").cast("string")).mapInArrow(count, "lang string, bucket int, n double")
    counts: dict[str, np.ndarray] = {}
    for r in cells.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = round(r["n"] * 500, 3)
    return CodeModel(counts)


def identify(docs: DataFrame, model: CodeModel, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for each row, and the columns ``more``.

    Null texts, texts without a letter and an empty model give ``und`` with score 0. Equal losses go to
    the first language by name. Repeated rows are predicted alike; an empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col, *more)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=["doc_id", *more, "lang_pred", "score", "ambiguous"],
            )

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double, ambiguous boolean")
