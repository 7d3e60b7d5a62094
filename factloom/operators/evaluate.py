"""Scores of a layer: extraction sanity and agreement with a gold set of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import strip
from factloom.session import materialize

EITHER = "reconcilable_or_corroborate"
#: Characters of a gram; shorter needles are looked up by their whole text.
GRAM = 3
#: Needles that each text is searched for directly, and rows of a written table that are broadcast.
FEW_NEEDLES, BROADCAST_ROWS = 256, 200_000


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def extraction_sanity(facts: DataFrame) -> DataFrame:
    evidence = F.count_if(strip(F.coalesce("evidence_span", F.lit(""))) != "")
    value = F.count_if(F.col("normalized_value").isNotNull())
    totals = facts.agg(
        F.count("*").alias("total_facts"),
        evidence.alias("facts_with_evidence_span"),
        value.alias("facts_with_normalized_value"),
    )
    return totals.select(
        "total_facts",
        "facts_with_evidence_span",
        _percent(F.col("facts_with_evidence_span"), F.col("total_facts")).alias("pct_with_evidence_span"),
        "facts_with_normalized_value",
        _percent(F.col("facts_with_normalized_value"), F.col("total_facts")).alias("pct_with_normalized_value"),
    )


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; none of a shorter text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(runs)).otherwise(F.expr("cast(array() as array<string>)"))


def containing(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """``id, needle`` for every text (``id, text``) that contains a needle (``needle``, not empty).

    Up to ``FEW_NEEDLES`` needles are looked for in each text as it is read, and nothing but hits is written.
    More go through the texts' grams: each needle's rarest gram is found by counting, and an inverted index of
    those grams alone is joined and compared. Nothing passes the driver.
    """
    needles = materialize(needles.where("needle <> ''").distinct(), "needles")
    if needles.count() <= FEW_NEEDLES:
        return texts.join(F.broadcast(needles), F.contains("text", "needle")).select("id", "needle")
    parts = [_grams(F.col("needle"), size) for size in range(GRAM, 0, -1)]
    own = F.coalesce(*[F.when(F.size(p) > 0, p) for p in parts])
    asked = materialize(needles.select("needle", F.explode(own).alias("gram")), "needles")
    wanted = asked.select("gram").distinct()
    # Needles of three characters and more ask for grams of one size only: at most three numbers come back.
    sizes = sorted(r["n"] for r in wanted.select(F.length("gram").alias("n")).distinct().collect()) or [GRAM]
    every = F.concat(*[_grams(F.col("text"), size) for size in sizes])
    counts = texts.select(F.explode(every).alias("gram")).join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    met = asked.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = materialize(met.where("r.n > 0").select("needle", "r.gram"), "rarest")
    index = texts.select("id", F.explode(every).alias("gram")).join(rarest.select("gram").distinct(), "gram", "left_semi")
    return rarest.join(index, "gram").join(texts, "id").where(F.contains("text", "needle")).select("id", "needle")


def _broadcast_if_small(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written and counted, so that a few of them do not make the other side of a join move."""
    rows = materialize(rows, name)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _gold_hits(facts: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, gold items in lower case, claims that contain a text of a gold item)."""
    claims = facts.select("id", F.lower("claim_text").alias("text"))
    items = gold.select("item", F.lower("a_contains").alias("a"), F.lower("b_contains").alias("b"), F.col("relation").alias("wanted"))
    needles = items.select(F.explode(F.array("a", "b")).alias("needle"))
    return claims, items, materialize(containing(claims, needles), "hits")


def _candidates(claims: DataFrame, items: DataFrame, hits: DataFrame) -> DataFrame:
    """``item, a_candidates, b_candidates``; the empty text is in every claim."""
    counts = hits.groupBy("needle").agg(F.count("*").alias("n"))
    total = claims.agg(F.count(F.col("text")).alias("n")).select(F.lit("").alias("needle"), "n")
    counts = counts.unionByName(total)
    out = items
    for side in ("a", "b"):
        out = out.join(counts.select(F.col("needle").alias(side), F.col("n").alias(f"{side}_candidates")), side, "left")
    zero = F.lit(0).cast("long")
    return out.select("*", *[F.coalesce(f"{s}_candidates", zero).alias(f"n_{s}") for s in ("a", "b")]).drop("a_candidates", "b_candidates")


def gold_candidates(facts: DataFrame, gold: DataFrame) -> DataFrame:
    """Per gold ``item``: facts whose claim contains the text of side a, and of side b."""
    counted = _candidates(*_gold_hits(facts, gold))
    return counted.select("item", F.col("n_a").alias("a_candidates"), F.col("n_b").alias("b_candidates"))


def _matches(edges: DataFrame, claims: DataFrame, items: DataFrame, hits: DataFrame) -> DataFrame:
    """Items with an edge of their relation between a claim of each side, in either direction.

    The side with fewer claims leads to the edges; the other text is then compared. ``items`` are counted.
    """
    a_leads = (F.col("a") != "") & ((F.col("b") == "") | (F.col("n_a") <= F.col("n_b")))
    sided = items.select(
        "item", "wanted", F.when(a_leads, F.col("a")).otherwise(F.col("b")).alias("needle"), F.when(a_leads, F.col("b")).otherwise(F.col("a")).alias("other")
    )
    pairs = edges.where(F.col("fact_a_id") != F.col("fact_b_id")).select(F.col("fact_a_id").alias("u"), F.col("fact_b_id").alias("v"), "relation")
    pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "relation"))
    fits = (F.col("relation") == F.col("wanted")) | ((F.col("wanted") == EITHER) & F.col("relation").isin("reconcilable", "corroborate"))
    leading = _broadcast_if_small(hits.withColumnRenamed("id", "u").join(F.broadcast(sided), "needle"), "leading")
    led = leading.join(pairs, "u").where(fits).select("item", "v", "other").distinct()
    led = _broadcast_if_small(led, "led").join(claims.withColumnRenamed("id", "v"), "v").where(F.contains("text", "other")).select("item")
    # Two empty texts: any edge between known claims.
    both_empty = sided.where("needle = '' and other = ''")
    if both_empty.isEmpty():
        return led.distinct()
    known = pairs.join(claims.select(F.col("id").alias("u")), "u", "left_semi").join(claims.select(F.col("id").alias("v")), "v", "left_semi")
    free = both_empty.join(known.select("relation").distinct(), fits).select("item")
    return led.unionByName(free).distinct()


def gold_matches(facts: DataFrame, edges: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold rows with ``matched``: an edge in either direction, between two facts, of that relation."""
    return gold_report(facts, edges, gold).select(*gold.columns, "matched")


def gold_report(facts: DataFrame, edges: DataFrame, gold: DataFrame) -> DataFrame:
    """Per item: the gold fields, candidate counts and ``matched``."""
    claims, items, hits = _gold_hits(facts, gold)
    counted = materialize(_candidates(claims, items, hits), "counted")
    found = _matches(edges, claims, counted, hits).withColumn("matched", F.lit(True))
    counts = counted.select("item", F.col("n_a").alias("a_candidates"), F.col("n_b").alias("b_candidates"))
    return gold.join(found, "item", "left").join(counts, "item").withColumn("matched", F.coalesce("matched", F.lit(False)))


def gold_summary(report: DataFrame) -> DataFrame:
    totals = report.agg(F.count("*").alias("gold_total"), F.count_if("matched").alias("gold_matched"))
    return totals.withColumn("gold_match_pct", _percent(F.col("gold_matched"), F.col("gold_total")))
