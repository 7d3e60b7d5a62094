"""Secret scans: three fixed patterns, and strings that pass a battery of randomness tests.

The battery infers a token's encoding and tests, over that alphabet, uniformity (chi-squared), runs
above and below the middle, and serial correlation; a token with structure fails it. One that passes is
weighed against ordinary text: the chance of its letters under random encodings, over their chance after
each other in text, as the short words of the whole corpus or plain English show it. Under the hypothesis that the token is
text this ratio exceeds x with a chance of at most 1 / x, whatever the corpus holds, so its inverse is a
p-value; the Benjamini-Hochberg rule inside each class of lengths bounds the share of false finds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import id_and_text
from factloom.session import materialize

KINDS = ("assign", "access", "hex", "random")

# Fixed patterns of the base kinds. Those with a least length that does not change where the next
# match may start state it in the pattern; "assign" is filtered afterwards.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Runs that the battery looks at; shorter ones are ordinary words.
LEAST_SIZE = 16
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_SIZE)
LENGTH_CLASSES = (16, 20, 28, 40, 64)
DIGITS, LOWER, SIGNS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "+/_-"
UPPER = LOWER.upper()
#: Encodings, small alphabets first.
ALPHABETS = (
    ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("lower letters", LOWER), ("upper letters", UPPER),
    ("base32", UPPER + "234567"), ("lower", LOWER + DIGITS), ("upper", UPPER + DIGITS), ("letters", UPPER + LOWER),
    ("alnum", UPPER + LOWER + DIGITS), ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("any", UPPER + LOWER + DIGITS + SIGNS),
)
PLACES = tuple((name, {c: i for i, c in enumerate(letters)}) for name, letters in ALPHABETS)
#: A token that the battery calls random less often than this has structure.
LEVEL = 0.001
#: Steps of the evidence against text: tenths of a decade, the last one open.
STEPS = 400

SYMBOLS = LOWER + UPPER + DIGITS + SIGNS
START = len(SYMBOLS)
#: Shares of the letters a to z in English, in thousandths.
LETTER_SHARES = (
    82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 0.95, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.74
)
#: Chances of a lower letter, upper letter, digit or sign after each of them and at the start.
KIND_SHARES = (
    (0.94, 0.02, 0.01, 0.03), (0.45, 0.45, 0.05, 0.05), (0.05, 0.05, 0.80, 0.10), (0.60, 0.20, 0.15, 0.05), (0.60, 0.30, 0.08, 0.02)
)
#: Weight of these shares against what follows a letter in the corpus, in letters seen.
PRIOR = 50


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str) -> float:
    """Combined p-value of the battery over the smallest fitting alphabet, near 0 for tokens with structure."""
    body = token.rstrip("=")
    used = set(body)
    places = next(p for _, p in PLACES if used <= p.keys())
    n, k = len(body), len(places)
    at = [places[c] for c in body]
    counts: dict[int, int] = {}
    for i in at:
        counts[i] = counts.get(i, 0) + 1
    chi = sum(c * c for c in counts.values()) * k / n - n
    freedom = k - 1
    spread = 2 / (9 * freedom)  # Wilson and Hilferty
    uniform = _tail(((max(chi, 1e-9) / freedom) ** (1 / 3) - 1 + spread) / math.sqrt(spread))
    high = [i >= k / 2 for i in at]
    ups = sum(high)
    downs = n - ups
    if ups and downs:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * ups * downs / n
        variance = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        swings = 2 * _tail(abs(runs - mean) / math.sqrt(variance))
    else:
        swings = 2.0 ** (1 - n)
    centre = sum(at) / n
    total = sum((i - centre) ** 2 for i in at)
    serial = sum((a - centre) * (b - centre) for a, b in zip(at, at[1:])) / total if total else 1.0
    related = 2 * _tail(abs(serial + 1 / n) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, swings, related))  # half of Fisher's statistic
    return math.exp(-half) * (1 + half + half * half / 2)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _length_class(n: int) -> int:
    return sum(n >= least for least in LENGTH_CLASSES) - 1


_CODES = np.full(256, -1, np.int16)
_CODES[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(START)


def followers(text: bytes) -> np.ndarray:
    """How often each symbol follows each other one, or the start, in runs too short for the battery."""
    codes = _CODES[np.frombuffer(b"\n" + text + b"\n", np.uint8)]
    cuts = np.flatnonzero(codes < 0)
    short = np.diff(cuts) - 1 < LEAST_SIZE
    inside = np.repeat(short, np.diff(cuts))[1:] if len(cuts) > 1 else np.zeros(0, bool)
    before, after = codes[cuts[0] : -2], codes[cuts[0] + 1 : -1]
    taken = inside & (after >= 0)
    pairs = np.where(before < 0, START, before)[taken].astype(np.int64) * START + after[taken]
    return np.bincount(pairs, minlength=(START + 1) * START)


def text_costs(seen: np.ndarray) -> list[list[float]]:
    """Minus the logarithm of the chance of each symbol after each other one, or the start, in text."""
    letters = np.array(LETTER_SHARES) / sum(LETTER_SHARES)
    own = [letters, letters, np.full(10, 0.1), np.full(len(SIGNS), 1 / len(SIGNS))]
    kinds = np.repeat(np.arange(4), [len(x) for x in own])
    expected = np.array(KIND_SHARES)[np.r_[kinds, 4]][:, kinds] * np.concatenate(own)
    seen = seen.reshape(START + 1, START)
    return (-np.log((seen + PRIOR * expected) / (seen.sum(axis=1, keepdims=True) + PRIOR))).tolist()


def evidence(token: str, *models: list[list[float]]) -> float:
    """Logarithm of the token's chance as a random string over that as text, encodings and models being equally likely."""
    body = token.rstrip("=")
    used, n = set(body), len(body)
    fits = [len(p) for _, p in PLACES if used <= p.keys()]
    least = fits[0]
    random = math.log(sum((least / k) ** n for k in fits) / len(PLACES)) - n * math.log(least)
    codes = _CODES[np.frombuffer(body.encode(), np.uint8)].tolist()
    costs = [sum(costs[before][code] for before, code in zip([START, *codes], codes)) for costs in models]
    low = min(costs)
    return random + low - math.log(sum(math.exp(low - c) for c in costs) / len(costs))


def _scan(batches: Iterator[pa.RecordBatch], *models: list[list[float]]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    test = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("size", pa.int32()), ("step", pa.int32())]))
    for batch in batches:
        spans, tests = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            own = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
            ends = np.maximum.accumulate([e for _, _, e in own]) if own else []
            rows, k = [], 0
            for m in TOKEN.finditer(text):
                while k < len(own) and own[k][0] < m.end():
                    k += 1
                if k and ends[k - 1] > m.start():
                    continue  # what a pattern has found is found
                found = evidence(m[0], *models)
                random = found > 0 and randomness(m[0]) >= LEVEL
                step = min(STEPS, int(10 * found / math.log(10))) if random else 0
                rows.append({"start": m.start(), "end": m.end(), "size": _length_class(len(m[0])), "step": step})
            tests.append(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span), pa.array(tests, test)], names=["doc_id", "spans", "tests"])


def discovery_steps(counts: list[tuple[int, int, int]], share: float) -> list[int]:
    """First step found of each length class, from (class, step, n) rows; beyond the last step if none is."""
    first = []
    for size in range(len(LENGTH_CLASSES)):
        steps = [0] * (STEPS + 1)
        for s, step, n in counts:
            steps[step] += n if s == size else 0
        total, over, least = sum(steps), 0, STEPS + 1
        for step in range(STEPS, 0, -1):
            over += steps[step]
            if over and 10 ** (-step / 10) * total <= share * over:
                least = step
        first.append(least)
    return first


def secrets(docs: DataFrame, share: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` for each row.

    ``spans`` lists kind:start:end in code points, by start and then kind. Random strings never overlap a
    fixed pattern; ``share`` bounds the expected share of ordinary text among them. All runs of 16 or more
    letters, digits and ``+/_-`` are tested, those of letters or digits alone too; runs of digits never stand
    out from ordinary numbers. Null text counts as empty: no spans, and the digest of the empty string.
    Repeated rows are scanned alike and a very long text as any other, in time that grows with its length;
    an empty table gives no rows. Without any ordinary word the shares of English stand for text.
    """
    docs = id_and_text(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((START + 1) * START, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    total += followers(text)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    # At most 67 * 66 sums, whatever the corpus.
    sums = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros((START + 1) * START)
    for pair, n in sums:
        seen[pair] = n
    models = text_costs(seen), text_costs(np.zeros_like(seen))  # text of this corpus, and any English text
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, spans array<struct<start: long, kind: int, end: long>>, "
        "tests array<struct<start: long, end: long, size: int, step: int>>"
    )
    found = materialize(docs.mapInArrow(lambda batches: _scan(batches, *models), schema), "spans")
    cells = found.select(F.explode("tests").alias("t")).groupBy("t.size", "t.step").count()
    limits = F.array(*[F.lit(step) for step in discovery_steps([tuple(r) for r in cells.collect()], share)])
    random = F.transform(
        F.filter("tests", lambda t: t["step"] >= F.element_at(limits, t["size"] + 1)),
        lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")),
    )

    def listed(spans):
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(
            F.transform(
                F.array_sort(spans),
                lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
            ),
            ",",
        )

    def number(place):
        return F.size(F.filter("spans", lambda s: s["kind"] == place)).cast("long")

    return found.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.size(random).cast("long").alias("n_random"),
        F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(F.concat("spans", random)).alias("spans"),
    )
