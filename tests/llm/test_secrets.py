"""The random spans of the secret scan against a plain version, and on planted keys."""

import collections
import math
import random
import re
import string
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from factloom.llm import secrets as scan

BASE62 = string.ascii_letters + string.digits


def drawn(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def prose(rng, n):
    vocabulary = ["time", "house", "ninety", "thought", "Garden", "letters", "the", "of", "reading", "whether", "and", "state-of-the-art"]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def brute_spans(texts, share):
    """Random spans of all texts: counts, chances and the discovery rule, token by token."""
    follows = collections.Counter()
    for text in texts:
        for run in re.findall(r"[A-Za-z0-9+/_-]+", text):
            if len(run) < 16:
                follows.update(zip(["start", *run], run))
    kinds = [string.ascii_lowercase, string.ascii_uppercase, string.digits, "+/_-"]
    totals = collections.Counter()
    for (before, _), n in follows.items():
        totals[before] += n

    def chance(before, c, follows, totals):
        kind = next(i for i, k in enumerate(kinds) if c in k)
        was = 4 if before == "start" else next(i for i, k in enumerate(kinds) if before in k)
        among = scan.LETTER_SHARES[kinds[kind].index(c)] / sum(scan.LETTER_SHARES) if kind < 2 else 1 / len(kinds[kind])
        return (follows[before, c] + 50 * scan.KIND_SHARES[was][kind] * among) / (totals[before] + 50)

    classes = collections.defaultdict(list)
    for doc, text in enumerate(texts):
        own = scan.base_spans(text)
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", text):
            if any(s < m.end() and m.start() < e for s, _, e in own):
                continue
            body = m[0].rstrip("=")
            as_random = sum(Fraction(1, len(letters) ** len(body)) for _, letters in scan.ALPHABETS if set(body) <= set(letters)) / len(scan.ALPHABETS)
            pairs = list(zip(["start", *body], body))
            as_text = [math.prod(Fraction(chance(b, c, *model)) for b, c in pairs) for model in ((follows, totals), (collections.Counter(),) * 2)]
            ratio = math.log10(Fraction(as_random) / sum(as_text) * 2)
            if scan.randomness(m[0]) < 0.001:
                ratio = 0
            classes[sum(len(m[0]) >= x for x in (16, 20, 28, 40, 64))].append((min(400, max(0, int(10 * ratio))), doc, m.start(), m.end()))
    found = set()
    for tests in classes.values():
        tests.sort(reverse=True)
        last = max((k for k, t in enumerate(tests, 1) if t[0] > 0 and 10 ** (-t[0] / 10) * len(tests) / k <= share), default=0)
        found |= {t[1:] for t in tests if last and t[0] >= tests[last - 1][0]}
    return found


def random_spans(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = scan.secrets(df, **how).collect()
    spans = {(r.doc_id, *map(int, s.split(":")[1:])) for r in got for s in r.spans.split(",") if s.startswith("random")}
    assert sum(r.n_random for r in got) == len(spans)
    return spans


@pytest.mark.parametrize("seed,share", [(1, 0.05), (2, 0.5)])
def test_random_spans_equal_a_plain_version(spark, seed, share):
    rng = random.Random(seed)
    texts = ["", "é" * 20 + " " + drawn(rng, BASE62, 24), "a" * 16 + "1" * 16]
    for _ in range(60):
        words = prose(rng, 30).split()
        for _ in range(rng.randrange(4)):
            letters = rng.choice([BASE62, string.ascii_lowercase, "etaoinshr", "01", string.digits, BASE62 + "+/", "abc-/_", string.hexdigits[:16]])
            words.insert(rng.randrange(30), drawn(rng, letters, rng.randint(14, 44)) + rng.choice(["", "", "=", "=="]))
        words.insert(5, rng.choice(["password=" + drawn(rng, BASE62, 20), "internationalisation", "over/and_over/and_over", "AKIA" + "Q7" * 9]))
        texts.append(rng.choice([" ", "\n", ", "]).join(words))
    expected = brute_spans(texts, share)
    assert random_spans(spark, texts, share=share) == expected and len(expected) > 20


def test_keys_are_found_with_and_without_ordinary_words(spark):
    rng = random.Random(3)
    keys = [drawn(rng, BASE62, 40) for _ in range(20)]
    assert len(random_spans(spark, keys)) >= 19  # nothing but keys
    letters = [drawn(rng, string.ascii_letters, 40) for _ in range(20)]
    words = [drawn(rng, "etaoin", rng.randint(16, 30)) for _ in range(300)]
    assert {d for d, _, _ in random_spans(spark, [*letters, " ".join(words)])} >= set(range(20)) - {20}
    lower = [drawn(rng, string.ascii_lowercase, 40) for _ in range(20)]
    assert len(random_spans(spark, [*lower, prose(rng, 5000)])) >= 19


def test_ordinary_text_is_left_alone_and_long_texts_take_linear_time(spark):
    rng = random.Random(4)
    numbers = " ".join(drawn(rng, string.digits, 16) for _ in range(200))
    long_words = "internationalisation responsibilities mother-in-law_and_father-in-law src/main/java/reading/Whether " * 50
    assert random_spans(spark, [prose(rng, 4000), numbers, long_words, "=" * 50, "-" * 5000, "z" * 3000]) == set()
    planted = drawn(rng, BASE62, 32)
    text = " ".join([prose(rng, 200_000), planted, " ".join(f"token=value{i:07d}" for i in range(20_000))])
    assert {text[s:e] for _, s, e in random_spans(spark, [text, text])} == {planted}


def test_repeated_rows_and_nulls(spark):
    rng = random.Random(5)
    key = drawn(rng, BASE62, 40)
    rows = [(1, key), (1, key), (None, key), (2, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("step", F.lit("clash")).withColumn("n", F.lit(0))
    got = sorted((str(r.doc_id), r.n_random, r.spans) for r in scan.secrets(df).collect())
    assert got == [("1", 1, "random:0:40")] * 2 + [("2", 0, ""), ("None", 0, ""), ("None", 1, "random:0:40")]
