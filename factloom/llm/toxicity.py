"""Toxicity by a weighted lexicon.

Texts are folded (case, compatibility forms, homoglyphs, digits for letters) and searched once with an
Aho-Corasick automaton for lexicon words and exception phrases; a word inside an exception phrase does
not count. Weights come from labelled rows, and so does the curve that turns the weight found, alone
and in relation to the text's length, into a score.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import id_and_text, released
from factloom.session import materialize

#: Labelled rows learned from, at most about so many; a fixed hash picks them.
TRAIN_ROWS = 40_000
#: Largest lexicon, and what a word needs to enter it; word beginnings ("stem*") need more.
MAX_WORDS, LEAST_DOCS, LEAST_WEIGHT = 20_000, 3, 2.0
#: Words a task counts at a time; their counts are added up by Spark.
HELD_WORDS = 100_000
STEMS, STEM_DOCS, STEM_WEIGHT = (4, 5, 6), 5, 3.0
#: Insults known without labels, with their weight, and phrases in which such words are harmless.
PRIOR = ("idiot", "moron", "imbecile", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "bastard", "retard", "asshole")
PRIOR_WEIGHT = 3.0
EXCEPTIONS = ("pathetic fallacy", "sore loser penalty", "pond scum", "village idiot theatre", "not stupid")

# Letters of other scripts that look like Latin ones, then digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
INVISIBLE = "­​‌‍⁠﻿"


#: Signs in a row, with marks that are not seen among them, that no letter or digit follows: punctuation.
_MARKS = "!|$@" + INVISIBLE
_PUNCTUATION = re.compile(rf"(?<![{_MARKS}])[{_MARKS}]++(?![^\W_])")


def _table() -> dict[int, str]:
    table = {ord(k): SUBSTITUTES.get(v, v) for k, v in HOMOGLYPHS.items()}
    table |= {ord(k): v for k, v in SUBSTITUTES.items()}
    table |= {ord(c): "" for c in INVISIBLE}
    for code in range(128):
        c = chr(code)
        if code not in table and not c.isalnum():
            table[code] = " "
    return table


_FOLD = _table()


def folded(text: str) -> str:
    """Words of the folded text between single marks; ``l``, ``1``, ``!`` and ``i`` are one letter."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", low).lower()
    # A sign is a letter where a letter or digit follows, perhaps after more signs, and a blank elsewhere.
    if any(sign in low for sign in "!|$@"):
        low = _PUNCTUATION.sub(lambda m: " " if m[0].strip(INVISIBLE) else m[0], low)
    return f" {' '.join(low.translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """Folded words with weights, exception phrases, and the curve of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-1.0, 1.0, 0.5)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                stem = word.endswith("*")
                found.add_word(f" {word[:-1]}" if stem else f" {word} ", (len(word), weight))
            for phrase in self.exceptions:
                found.add_word(folded(phrase), (len(folded(phrase)) - 2, 0.0))
            if len(found):
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float]:
        """Log of the weight found, and of the weight per hundred words."""
        if not text or not len(self.automaton()):
            return 0.0, 0.0
        plain = folded(text)
        hits, safe = [], []
        for end, (size, weight) in self.automaton().iter(plain):
            (hits if weight > 0 else safe).append((end - size, end, weight))
        total = sum(w for a, b, w in hits if not any(s <= a and b <= e for s, e, _ in safe))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, plain.count(" ") - 1)))

    def score(self, text: str | None) -> float:
        level, dense = self.features(text)
        bias, a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(bias + a * level + b * dense, -30, 30))))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps."""
    data = np.c_[np.ones(len(x)), x]
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
        step = np.linalg.solve(data.T @ (data * (p * (1 - p))[:, None]) + ridge, data.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon from documents and (doc_id, toxic) rows, of which a bounded, fixed sample is used.

    Near copies would lend their chance words weight, so one text per smallest word-pair hash is used.
    Two thirds of the texts give the weights, the others the curve. Only words that pass the limits and
    two numbers per text of the bounded sample reach the driver. Without labels of both kinds the prior
    words and a fixed curve are used.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    if n > train_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    # The bound on the rows is what allows the broadcast.
    texts = docs.where(F.col("text").isNotNull()).join(F.broadcast(marks), "doc_id").select("text", "toxic")
    sample = texts.mapInArrow(_signed, "text string, toxic int, mark long")
    sample = materialize(sample.groupBy("mark").agg(F.max_by(F.struct("text", "toxic"), "text").alias("r")).select("mark", "r.*"), "sample")
    third = F.pmod(F.xxhash64("mark"), F.lit(3))
    cells = sample.where(third > 0).select("text", "toxic").mapInArrow(_word_counts, "word string, toxic long, clean long")
    counts = cells.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    classes = {r["toxic"]: r["n"] for r in sample.where(third > 0).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = classes.get(1, 0), classes.get(0, 0)
    prior = {folded(w).strip(): PRIOR_WEIGHT for w in PRIOR}
    if not toxic or not clean:
        return Lexicon(prior, exceptions)
    weight = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 2.0) / (clean + 4.0))
    stem = F.col("word").endswith("*")
    least_docs, least_weight = F.when(stem, STEM_DOCS).otherwise(LEAST_DOCS), F.when(stem, STEM_WEIGHT).otherwise(LEAST_WEIGHT)
    chosen = counts.select("word", "a", weight.alias("w")).where((F.col("a") >= least_docs) & (F.col("w") >= least_weight))
    top = chosen.orderBy((F.col("a") * F.col("w")).desc(), "word").limit(MAX_WORDS).collect()
    seen = {r["word"]: r["b"] for r in counts.where(F.col("word").isin(list(prior))).collect()}
    weights = {w: p for w, p in prior.items() if not seen.get(w)} | {r["word"]: float(r["w"]) for r in top}
    lexicon = Lexicon(weights, exceptions)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([shared.value.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], names=["level", "dense", "toxic"])

    points = sample.where(third == 0).select("text", "toxic").mapInArrow(measure, "level double, dense double, toxic int").toPandas()
    if points["toxic"].nunique() == 2:
        lexicon.curve = _fit_curve(points[["level", "dense"]].to_numpy(), points["toxic"].to_numpy(float))
    return lexicon


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        marks = []
        for text in batch.column(0).to_pylist():
            words = text.lower().split()
            pairs = set(zip(words, words[1:])) or {tuple(words)}
            marks.append(min(xxhash.xxh64_intdigest(" ".join(p)) for p in pairs) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64())], names=["text", "toxic", "mark"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[int]] = {}

    def rows():
        words = list(held)
        counts = np.array([held[w] for w in words], np.int64).reshape(-1, 2)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts[:, 1]), pa.array(counts[:, 0])], names=["word", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(folded(text).split())
            for word in words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}:
                held.setdefault(word, [0, 0])[1 if toxic else 0] += 1
            if len(held) > HELD_WORDS:
                yield rows()
    yield rows()
    released()


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row; predicted is 1 from a score of 0.5.

    Null and empty texts score as texts in which nothing was found. Repeated rows score alike; an empty
    table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col)
    shared: object = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([shared.value.score(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )
        released()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
