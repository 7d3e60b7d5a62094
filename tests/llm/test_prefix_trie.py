"""The prefix trie against a plain one."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import prefix_trie as module
from factloom.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a int, n_convs int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows, rebuild=True):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t.decode()) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = own.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])
        built[c] = base[:h] + turns[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in built.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(node[:-1] for node in members if node)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, who in members.items()
    )


def run(spark, rows, rebuild=True):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    conv = F.col("conv_id")
    kind = {"base": conv - conv % 100, "head": F.crc32(conv.cast("string").cast("binary")) % 6, "most": 5} if rebuild else {}
    return sorted(tuple(r[c] for c in COLUMNS) for r in conversation_trie(df, **kind).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    says = ["hello", "héllo 😀", "", None, "how are you", "fine", "x" * 3000]
    out = []
    for c in [*range(0, 130), *range(195, 230), 405, -3, -101, -230]:
        n = rng.randint(1, 8)
        same = rng.random() < 0.5
        for turn in range(n):
            text = says[turn % len(says)] if same else rng.choice(says)
            out.append((c, turn if rng.random() < 0.97 else None, "user" if turn % 2 == 0 else rng.choice(["bot", None]), text))
    long = [(500, turn, "user", f"t{turn // 7}") for turn in range(75)]
    out += long + [(501, *r[1:]) for r in long] + [(502, *r[1:]) for r in long[:60]] + [(503, *r[1:]) for r in long[:40]] + [(503, 99, "u", "end")]
    out += [(600 + i, 0, "user", "one very common turn") for i in range(90)]  # a third of all conversations
    out += [(None, 0, "user", "no id"), (7, 0, "user", "hello"), (7, 0, "user", "hello"), (7, 0, "bot", "hello"), (8, None, None, None)]
    return out


def test_trie_equals_a_plain_one(spark, rows, monkeypatch):
    wanted = plain(rows)
    assert run(spark, rows) == wanted
    monkeypatch.setattr(module, "BAND", 3)  # four levels of bands, many blocks, many pieces
    monkeypatch.setattr(module, "BLOCK", 6)
    monkeypatch.setattr(module, "PIECE", 20)
    assert run(spark, rows) == wanted


def test_awkward_tables(spark):
    assert run(spark, []) == run(spark, [(None, 1, "a", "b")]) == []
    # 3 has five turns of a conversation that is absent and none left: it ends in the root.
    absent = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    alone = [(absent, 0, "user", "gone")]
    root = (absent, 0, None, 1, 0, 1, 0, hashlib.sha256(str(absent).encode()).hexdigest())
    assert run(spark, alone) == plain(alone) == [root]
    plainly = [(1, 0, "a", "b"), (2, 0, "a", "b"), (2, 1, "a", "c")]
    assert run(spark, plainly, rebuild=False) == plain(plainly, rebuild=False)
