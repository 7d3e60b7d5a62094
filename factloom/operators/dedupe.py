"""Near-duplicate suppression within a document: greedy leader clusters and survivors.

Facts of one document with the same subject form a block. In order, a fact joins the first cluster
whose leader overlaps it, else it becomes a leader. Equal spans always share a cluster, so the work
is done on distinct spans. Blocks up to ``block_limit`` distinct spans are folded in one array
expression; larger ones take a distributed path with the same result: leaders are the greedy
independent set of the overlap relation in span order, with overlap candidates from rare shared
signatures instead of all pairs.

Two parallel rounds (Blelloch et al., 2012) settle dense groups, whose first span leads all others.
What is left is sparse: its overlaps are written once as pairs of numbers, and each block, or each
connected part of a larger one, is decided in order by one task that streams its sorted pairs. So
the number of jobs does not grow with the longest chain of overlaps. Only a part of more than
``PART_PAIRS`` pairs goes on in rounds, on numbers alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import let, normal_span, sets_similar, spans_overlap, strip, token_set
from factloom.operators.clusters import components
from factloom.session import materialize

BLOCK = ["doc_id", "subject_key"]
BLOCK_LIMIT = 1024
BLOCK_CHARS = 1 << 20
GRAM = 3
LONG_TOKEN = 4096
#: Rounds that settle dense groups, and pairs that one task decides in order.
DENSE_ROUNDS = 2
PART_PAIRS = 4_000_000
#: Signature rows that one comparison of spans shuffles at a time; more are compared in shares of their keys,
#: up to so many shares, as each reads the signatures once.
SHARE_ROWS, SHARES = 500_000, 16
#: Dropped facts that are broadcast; with more, the facts are shuffled to meet them.
BROADCAST_DROPPED = 100_000


def _fold_block(spans: Column) -> Column:
    """Ordered ``array<struct<seq, span, tokens>>`` to ``array<struct<seq, leader>>``."""
    leaders_type = "array<struct<seq:bigint,span:string,tokens:array<string>>>"
    start = F.struct(
        F.expr(f"cast(array() as {leaders_type})").alias("leaders"),
        F.expr("cast(array() as array<struct<seq:bigint,leader:bigint>>)").alias("placed"),
    )

    def step(acc: Column, x: Column) -> Column:
        hits = F.filter(acc.leaders, lambda l: spans_overlap(l.span, l.tokens, x.span, x.tokens))
        first = F.get(F.transform(hits, lambda h: h.seq), F.lit(0))
        return let(
            first,
            lambda hit: F.struct(
                F.when(hit.isNull(), F.array_append(acc.leaders, x)).otherwise(acc.leaders).alias("leaders"),
                F.array_append(
                    acc.placed, F.struct(x.seq.alias("seq"), F.coalesce(hit, x.seq).alias("leader"))
                ).alias("placed"),
            ),
        )

    return F.aggregate(spans, start, step, lambda acc: acc.placed)


def _small_blocks(spans: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("seq", "span", "tokens")))
    folded = spans.groupBy(*BLOCK).agg(ordered.alias("spans"))
    return folded.select(*BLOCK, F.explode(_fold_block(F.col("spans"))).alias("p")).select(
        *BLOCK, F.col("p.seq").alias("seq"), F.col("p.leader").alias("leader")
    )


def _grams(token: Column, sizes: list[int]) -> Column:
    """Distinct character grams of the given sizes."""
    empty = F.expr("cast(array() as array<string>)")

    def of(chars: Column) -> Column:
        n = F.length(token)

        def runs(size: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
            direct = F.transform(starts, lambda i: F.substring(token, i, F.lit(size)))
            # Seeking in a string takes time linear in the position, in an array it does not.
            cut = F.transform(starts, lambda i: F.array_join(F.slice(chars, i, size), ""))
            return F.when(n < size, empty).when(n <= LONG_TOKEN, direct).otherwise(cut)

        return F.array_distinct(F.concat(*[runs(size) for size in sizes]))

    return let(F.when(F.length(token) > LONG_TOKEN, F.split(token, "")), of)


def _tokens_holding(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(block, part, key): the tokens of the block's vocabulary that contain the part.

    Joined on the part's rarest gram; only the distinct tokens are cut into grams, not the spans.
    """
    full = F.least(F.length("part"), F.lit(GRAM))
    sizes = sorted(row.n for row in parts.select(full.alias("n")).distinct().collect())
    if not sizes:
        return parts.withColumn("key", F.lit(""))
    grams = vocabulary.join(parts.select(*BLOCK).distinct(), BLOCK, "left_semi").select(
        *BLOCK, "key", F.explode(_grams(F.col("key"), sizes)).alias("gram")
    )
    counts = grams.groupBy(*BLOCK, "gram").agg(F.count("*").alias("n"))
    rarest = (
        parts.select(*BLOCK, "part", F.explode(_grams(F.col("part"), sizes)).alias("gram"))
        .where(F.length("gram") == full)
        .join(counts, [*BLOCK, "gram"])
        .groupBy(*BLOCK, "part")
        .agg(F.min(F.struct("n", "gram")).alias("r"))
        .select(*BLOCK, "part", F.col("r.gram").alias("gram"))
    )
    return rarest.join(grams, [*BLOCK, "gram"]).where(F.contains("key", "part")).select(*BLOCK, "part", "key")


def _signatures(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signature rows (left, right) such that overlapping spans always share a key.

    Jaccard >= 4/5: both sets share a token among the rarest ``n - ceil(4n/5) + 1`` of each (prefix
    filter). Containment: the inner words of the inner span are words of the outer one, so its
    rarest inner word is a key; a span of one or two words takes the words that contain its longer
    word. Rare means rare within the block: a common word is no key unless there is nothing else.
    A word of one span only is no key. A row carries what its test reads: tokens for Jaccard, else the span.
    """
    tokens = spans.select(*BLOCK, "seq", F.explode("tokens").alias("key"))
    counts = materialize(tokens.groupBy(*BLOCK, "key").agg(F.count("*").alias("n")), "counts")
    by_rarity = F.array_sort(F.collect_list(F.struct("n", "key")))
    take = (F.size("t") - F.ceil(F.size("t") * 4 / 5) + 1).cast("int")
    prefixes = (
        tokens.join(counts, [*BLOCK, "key"])
        .groupBy(*BLOCK, "seq")
        .agg(by_rarity.alias("t"))
        .select(*BLOCK, "seq", F.explode(F.slice("t", F.lit(1), take)).alias("t"))
        .where(F.col("t.n") > 1)
        .select(*BLOCK, "seq", F.concat(F.lit("t"), F.col("t.key")).alias("key"))
    )
    worded = spans.select(*BLOCK, "seq", F.split("span", " ").alias("words"))
    inner = worded.where(F.size("words") > 2).select(
        *BLOCK, "seq", F.explode(F.expr("slice(words, 2, size(words) - 2)")).alias("key")
    )
    long_probes = (
        inner.join(counts, [*BLOCK, "key"])
        .groupBy(*BLOCK, "seq")
        .agg(F.min(F.struct("n", "key")).alias("r"))
        .where(F.col("r.n") > 1)
        .select(*BLOCK, "seq", F.col("r.key").alias("key"))
    )
    longer = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    short = worded.where(F.size("words") <= 2).select(*BLOCK, "seq", longer.w.alias("part"))
    holding = _tokens_holding(short.select(*BLOCK, "part").distinct(), counts.select(*BLOCK, "key"))
    short_probes = short.join(holding, [*BLOCK, "part"]).select(*BLOCK, "seq", "key")
    probes = materialize(long_probes.unionByName(short_probes), "probes")
    inside = tokens.join(probes.select(*BLOCK, "key").distinct(), [*BLOCK, "key"], "left_semi")

    def tagged(rows: DataFrame, tag: str) -> DataFrame:
        return rows.select(*BLOCK, "seq", F.concat(F.lit(tag), F.col("key")).alias("key"))

    def with_span(rows: DataFrame) -> DataFrame:
        similar = F.col("key").startswith("t")
        read = {"span": F.when(~similar, F.col("span")), "tokens": F.when(similar, F.col("tokens"))}
        return rows.join(spans, [*BLOCK, "seq"]).withColumns(read)

    left = prefixes.unionByName(tagged(probes, "p")).unionByName(tagged(inside, "i"))
    right = prefixes.unionByName(tagged(probes, "i")).unionByName(tagged(inside, "p"))
    return materialize(with_span(left), "left"), materialize(with_span(right), "right")


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Rows of ``left`` against earlier overlapping rows of ``right`` (the test is in the join).

    Token keys stand for the Jaccard test, which needs sets of similar size; the other keys for
    containment in their direction.
    """
    r = right.select(
        *[F.col(c).alias("r_" + c) for c in [*BLOCK, "key", "seq", "span", "tokens"]]
    )
    keys = [left[c] == r["r_" + c] for c in [*BLOCK, "key"]]
    similar = sets_similar(left.tokens, r.r_tokens)
    test = (
        F.when(left.key.startswith("t"), similar)
        .when(left.key.startswith("p"), F.contains(r.r_span, left.span))
        .otherwise(F.contains(left.span, r.r_span))
    )
    return left.join(r, keys[0] & keys[1] & keys[2] & (r.r_seq < left.seq) & test, how)


def _in_shares(left: DataFrame, right: DataFrame, shares: int, how: str, out, name: str) -> DataFrame:
    """``out`` of :func:`_joined`, written share by share of the keys: what one share shuffles is freed with it."""

    def share(rows: DataFrame, n: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64(*BLOCK, "key"), F.lit(shares)) == n) if shares > 1 else rows

    found = None
    for n in range(shares):
        mine = share(left, n)
        part = materialize(out(_joined(mine, share(right, n), how), mine), name)
        found = part if found is None else found.unionByName(part)
    return found


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaders of the parts of a partition, whose pairs come sorted by part, second and first.

    A span leads unless an earlier leader overlaps it. One part's decisions are held at a time.
    """
    part, led, current, free = None, {}, None, True

    def close() -> None:
        if current is not None:
            led[current] = free

    for batch in batches:
        out: list[tuple] = []
        for *key, first, second in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != part:
                close()
                out += [(*part[1:], seq) for seq, leads in led.items() if leads] if part else []
                part, led, current, free = key, {}, None, True
            if second != current:
                close()
                current, free = second, True
            leads = led.setdefault(first, True)  # a span without earlier overlaps is never second: it leads
            free = free and not leads
        yield _nodes_batch(out)
    close()
    yield _nodes_batch([(*part[1:], seq) for seq, leads in led.items() if leads] if part else [])


def _nodes_batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, subject, seq = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.string()), pa.array(subject, pa.string()), pa.array(seq, pa.int64())], names=[*BLOCK, "seq"]
    )


def _leaders_in_order(spans: DataFrame, pairs: DataFrame, part_pairs: int | None = None) -> DataFrame:
    """Greedy leaders among ``spans`` (block, seq) whose overlaps are ``pairs`` (block, first, second)."""
    node, limit = [*BLOCK, "seq"], part_pairs or PART_PAIRS
    ends = F.explode(F.array("first", "second")).alias("seq")
    alone = spans.join(pairs.select(*BLOCK, ends).distinct(), node, "left_anti")

    def decide(rows: DataFrame) -> DataFrame:
        """``rows`` are pairs with their ``part``."""
        dealt = rows.repartition("part", *BLOCK).sortWithinPartitions("part", *BLOCK, "second", "first")
        return dealt.select("part", *BLOCK, "first", "second").mapInArrow(_in_order, "doc_id string, subject_key string, seq long")

    large = pairs.groupBy(*BLOCK).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(*BLOCK)
    whole = pairs.withColumn("part", F.lit(0).cast("long"))
    if large.isEmpty():
        return alone.unionByName(decide(whole))
    large = materialize(large, "large_parts")
    usual = decide(whole.join(large, BLOCK, "left_anti").select(*whole.columns))
    big = pairs.join(large, BLOCK, "left_semi")
    name = lambda c: F.struct(*BLOCK, F.col(c).alias("seq"))
    parts = components(big.select(name("first").alias("u"), name("second").alias("v")))
    parts = parts.select("vertex.*", F.col("root.seq").alias("part")).withColumnRenamed("seq", "second")
    big = materialize(big.join(parts, [*BLOCK, "second"]), "parts")
    beyond = big.groupBy(*BLOCK, "part").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(*BLOCK, "part")
    usual = usual.unionByName(decide(big.join(beyond, [*BLOCK, "part"], "left_anti").select(*big.columns)))
    left = materialize(big.join(beyond, [*BLOCK, "part"], "left_semi").select(*BLOCK, "first", "second"), "beyond")
    undecided = materialize(left.select(*BLOCK, ends).distinct(), "undecided")
    rounds = alone.unionByName(usual)
    while not undecided.isEmpty():
        second = left.select(*BLOCK, F.col("second").alias("seq")).distinct()
        found = materialize(undecided.join(second, node, "left_anti"), "leaders")
        rounds = rounds.unionByName(found)
        led = left.join(found.withColumnRenamed("seq", "first"), [*BLOCK, "first"], "left_semi")
        gone = materialize(led.select(*BLOCK, F.col("second").alias("seq")).distinct().unionByName(found), "gone")
        undecided = materialize(undecided.join(gone, node, "left_anti"), "undecided")
        for side in ("first", "second"):
            left = left.join(gone.withColumnRenamed("seq", side), [*BLOCK, side], "left_anti")
        left = materialize(left.select(*BLOCK, "first", "second"), "beyond")
    return rounds


def _large_blocks(spans: DataFrame) -> DataFrame:
    """Distributed greedy leaders of large blocks."""
    node = [*BLOCK, "seq"]
    blank = spans.where(F.col("span") == "")
    blank_seq = blank.groupBy(*BLOCK).agg(F.min("seq").alias("blank"))
    # The empty span is inside every other one: as the first of its block it leads all, and
    # anywhere later it follows the first span.
    led_by_blank = (
        spans.join(spans.groupBy(*BLOCK).agg(F.min("seq").alias("first")), BLOCK)
        .join(blank_seq, BLOCK)
        .where((F.col("blank") == F.col("first")) | (F.col("seq") == F.col("blank")))
        .select(*node, F.col("first").alias("leader"))
    )
    rest = materialize(spans.join(led_by_blank, node, "left_anti"), "rest")
    left, right = _signatures(rest)
    shares = min(SHARES, max(1, -(-max(left.count(), right.count()) // SHARE_ROWS)))
    of = lambda mine, names: [mine[c] for c in names]
    by_node = lambda found, mine: found.select(*of(mine, node)).distinct()
    ends = lambda found, mine: found.select(*of(mine, BLOCK), F.col("r_seq").alias("first"), mine["seq"].alias("second")).distinct()
    first = lambda found, mine: found.groupBy(*of(mine, node)).agg(F.min("r_seq").alias("leader"))
    undecided = rest.select(*node)
    leaders = None
    for _ in range(DENSE_ROUNDS):
        mine = left.join(undecided, node, "left_semi")
        theirs = right.join(undecided, node, "left_semi")
        blocked = materialize(_in_shares(mine, theirs, shares, "left_semi", by_node, "blocked").distinct(), "blocked")
        found = materialize(undecided.join(blocked, node, "left_anti"), "leaders")
        leaders = found if leaders is None else leaders.unionByName(found)
        waiting = left.join(blocked, node, "left_semi")
        covered = _in_shares(waiting, right.join(found, node, "left_semi"), shares, "left_semi", by_node, "covered")
        undecided = materialize(blocked.join(covered, node, "left_anti"), "undecided")
    mine, theirs = (side.join(undecided, node, "left_semi") for side in (left, right))
    pairs = materialize(_in_shares(mine, theirs, shares, "inner", ends, "share-pairs").distinct(), "pairs")
    leaders = materialize(leaders.unionByName(_leaders_in_order(undecided, pairs)), "leaders")
    own = leaders.withColumn("leader", F.col("seq"))
    followers = left.join(leaders, node, "left_anti")
    assigned = _in_shares(followers, right.join(leaders, node, "left_semi"), shares, "inner", first, "assigned")
    assigned = assigned.groupBy(*node).agg(F.min("leader").alias("leader"))
    return own.unionByName(assigned).unionByName(led_by_blank)


def leader_clusters(
    facts: DataFrame, *, block_limit: int = BLOCK_LIMIT, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Add ``subject_key`` and ``leader`` (the ``seq`` of the cluster's first member).

    Needs ``doc_id, seq, subject, evidence_span``; ``seq`` (long) is the order within a document.
    """
    keyed = facts.withColumn("subject_key", F.lower(strip(F.col("subject")))).withColumn(
        "_span", normal_span(F.col("evidence_span"))
    )
    spans = (
        keyed.groupBy(*BLOCK, F.col("_span").alias("span"))
        .agg(F.min(F.col("seq").cast("long")).alias("seq"))
        .withColumn("tokens", token_set(F.col("span")))
    )
    spans = materialize(spans, "spans")
    sizes = spans.groupBy(*BLOCK).agg(F.count("*").alias("n"), F.sum(F.length("span")).alias("chars"))
    large = (F.col("n") > block_limit) | (F.col("chars") > block_chars)
    large_keys = sizes.where(large).select(*BLOCK)
    if large_keys.isEmpty():
        placed = _small_blocks(spans)
    else:
        large_keys = materialize(large_keys, "large")
        big = materialize(spans.join(large_keys, BLOCK, "left_semi"), "big")
        placed = _small_blocks(spans.join(large_keys, BLOCK, "left_anti")).unionByName(_large_blocks(big))
    leader_of = spans.join(placed, [*BLOCK, "seq"]).select(*BLOCK, F.col("span").alias("_span"), "leader")
    return keyed.join(leader_of, [*BLOCK, "_span"]).drop("_span")


def survivors(clustered: DataFrame) -> DataFrame:
    """``doc_id, seq`` of the most confident fact of each cluster, the earliest on ties."""
    best = F.max_by(F.col("seq"), F.struct(F.col("confidence"), (-F.col("seq")).alias("early")))
    return clustered.groupBy(*BLOCK, "leader").agg(best.alias("seq")).select("doc_id", "seq")


def _dropped_of_small(rows: DataFrame) -> DataFrame:
    """Facts of small blocks (``seq, span, confidence``) that do not survive, from one shuffle of them."""
    blocks = rows.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.struct("seq", "span", "confidence"))).alias("rows"))
    blocks = blocks.where(F.size("rows") > 1)
    firsts = F.aggregate(
        "rows",
        F.expr("cast(array() as array<struct<seq:bigint,span:string,tokens:array<string>>>)"),
        lambda acc, x: F.when(F.exists(acc, lambda s: s.span == x.span), acc).otherwise(
            F.array_append(acc, F.struct(x.seq.alias("seq"), x.span.alias("span"), token_set(x.span).alias("tokens")))
        ),
    )
    # As the one element of a list that is exploded, a value is made once, however often it is used and filtered.
    spans = blocks.select(*BLOCK, "rows", F.explode(F.array(firsts)).alias("spans"))
    placed = spans.select(*BLOCK, "rows", "spans", F.explode(F.array(_fold_block(F.col("spans")))).alias("placed"))
    # A block whose spans and rows all lead themselves drops nothing.
    placed = placed.where((F.size("placed") < F.size("rows")) | F.exists("placed", lambda p: p.seq != p.leader))
    named = F.transform("spans", lambda s: s.span).alias("spans")
    led = placed.select(*BLOCK, F.explode("rows").alias("r"), named, "placed")
    leader = F.get(F.col("placed"), (F.array_position("spans", F.col("r.span")) - 1).cast("int")).leader
    led = led.select(*BLOCK, "r.seq", "r.confidence", leader.alias("leader"))
    best = F.max_by("seq", F.struct("confidence", (-F.col("seq")).alias("early")))
    kept = led.groupBy(*BLOCK, "leader").agg(best.alias("best"), F.collect_list("seq").alias("seqs"))
    return kept.select(*BLOCK, F.explode(F.filter("seqs", lambda s: s != F.col("best"))).alias("seq"))


def dropped_facts(facts: DataFrame, *, block_limit: int = BLOCK_LIMIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, subject_key, seq`` of the near-duplicates among ``facts``, written.

    Small blocks are told from large ones by one count per block.
    """
    subject = F.lower(strip(F.col("subject")))
    narrow = facts.select("doc_id", F.col("seq").cast("long").alias("seq"), "subject", "evidence_span", "confidence")
    keyed = narrow.withColumn("subject_key", subject)
    sizes = keyed.groupBy(*BLOCK).agg(F.count("*").alias("n"), F.sum(F.length("evidence_span")).alias("chars"))
    large_keys = materialize(sizes.where((F.col("n") > block_limit) | (F.col("chars") > block_chars)).select(*BLOCK), "large")
    small, dropped = keyed, None
    if not large_keys.isEmpty():
        same = [keyed[c].eqNullSafe(large_keys[c]) for c in BLOCK]
        small = keyed.join(large_keys, same, "left_anti")
        big = materialize(keyed.join(large_keys, same, "left_semi"), "large-facts")
        kept = survivors(leader_clusters(big.drop("subject_key"), block_limit=block_limit, block_chars=block_chars))
        dropped = big.join(kept, ["doc_id", "seq"], "left_anti").select(*BLOCK, "seq")
    of_small = _dropped_of_small(small.select(*BLOCK, "seq", normal_span(F.col("evidence_span")).alias("span"), "confidence"))
    return materialize(of_small if dropped is None else of_small.unionByName(dropped), "dropped")


def without_dropped(facts: DataFrame, dropped: DataFrame) -> tuple[DataFrame, bool]:
    """``facts`` read past ``dropped``, and whether they are a narrow read: with few dropped they do not move."""
    n = dropped.count()
    if n == 0:
        return facts, True
    if n <= BROADCAST_DROPPED:
        dropped = F.broadcast(dropped)
    left = facts.withColumn("subject_key", F.lower(strip(F.col("subject"))))
    return left.join(dropped, [*BLOCK, "seq"], "left_anti").select(*facts.columns), n <= BROADCAST_DROPPED


def dedupe_facts(facts: DataFrame, *, block_limit: int = BLOCK_LIMIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Facts without near-duplicates; order by ``seq`` gives the input order."""
    return without_dropped(facts, dropped_facts(facts, block_limit=block_limit, block_chars=block_chars))[0]
