"""From documents to a layer: facts, candidate pairs and edges as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from factloom.functions.normalize import normalize_facts
from factloom.operators.chunking import MAX_CHARS, OVERLAP, chunk_documents, merged_text_pages
from factloom.operators.dedupe import dedupe_facts, dropped_facts, without_dropped
from factloom.operators.extraction import pattern_claims
from factloom.operators.layer import upsert_by_id
from factloom.operators.blocks import components_in_blocks, nearest_in_blocks
from factloom.operators.clusters import clusters_of
from factloom.operators.relate import (
    RULE_COLUMNS,
    TOP_K,
    adjudicate_by_rules,
    attribute_key,
    candidate_pairs,
    embed_claims,
    informative,
    rule_edges,
)
from factloom.schemas import FACT_FIELDS
from factloom.session import discard, materialize, spread

# Facts can only be related within these columns, so candidates are sought there.
MATCH = ["canonical_subject", "attribute_key"]


def build_claims(
    documents: DataFrame,
    extract: Callable[[DataFrame], DataFrame | tuple] | None = None,
    max_chars: int = MAX_CHARS,
    overlap: int = OVERLAP,
    observed: Observation | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(claims before de-duplication, report) of ``doc_id, text, ingest_seq`` rows.

    ``extract`` turns chunks into claims, or into claims and a report (``doc_id, n_failed, n_raw``, then
    whatever else); by default lines are matched by pattern, page by page. The report has a row for every
    document with something to report. ``observed`` counts the claims as they are written.
    """
    report = None
    if extract is None:
        carried = ("ingest_seq",)
        pages = merged_text_pages(spread(documents), keep=carried)
        found = pattern_claims(pages, max_chars, overlap, carried)
    else:
        found = extract(chunk_documents(spread(documents), max_chars, overlap))
        if isinstance(found, tuple):
            found, report = found[:2]
    found = normalize_facts(found)
    if observed is not None:
        found = found.observe(observed, F.count(F.lit(1)).alias("n_claims"))
    # Written once: the duplicate search reads the claims several times.
    claims = materialize(found, "claims")
    if report is None:
        report = claims.groupBy("doc_id").agg(F.count("*").alias("n_raw")).withColumn("n_failed", F.lit(0).cast("long"))
    return claims, report.select("doc_id", "n_raw", "n_failed")


def kept_facts(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims without near-duplicates, as facts in the order of their documents.

    Claims that carry the ``ingest_seq`` of their document are read past what is dropped and do not move.
    """
    return _as_facts(dedupe_facts(claims), documents)


def _as_facts(kept: DataFrame, documents: DataFrame) -> DataFrame:
    if "ingest_seq" in kept.columns:
        kept = kept.where(F.col("doc_id").isNotNull())
    else:
        kept = kept.join(documents.select("doc_id", "ingest_seq"), "doc_id")
    return kept.select(*FACT_FIELDS, "seq", "ingest_seq")


def build_facts(
    documents: DataFrame,
    extract: Callable[[DataFrame], DataFrame | tuple] | None = None,
    max_chars: int = MAX_CHARS,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Facts of ``doc_id, text, ingest_seq`` rows: chunk, extract, ground, normalise, de-duplicate.

    ``extract`` is as in :func:`build_claims`.
    """
    claims, _ = build_claims(documents, extract, max_chars, overlap)
    return kept_facts(claims, documents)


def stored_facts(documents: DataFrame) -> DataFrame:
    """:func:`build_facts` as a stored table: the claims themselves, read past the few that are dropped.

    Where many are dropped, what is left is written anew and the claims are deleted.
    """
    claims, _ = build_claims(documents)
    kept, narrow = without_dropped(claims, dropped_facts(claims))
    if narrow:
        return _as_facts(kept, documents)
    facts = materialize(_as_facts(kept, documents), "facts")
    discard(claims)
    return facts


def searchable(facts: DataFrame) -> DataFrame:
    """Facts with the embedding and the blocking columns of the candidate search."""
    keyed = facts.withColumn("attribute_key", attribute_key(F.col("attribute")))
    return embed_claims(keyed).select("id", "doc_id", "ingest_seq", "embedding", *MATCH)


def related_facts(facts: DataFrame, columns: list[str], top_k: int = TOP_K, match: list[str] | None = None) -> DataFrame:
    """``block, fact_a_id, fact_b_id, distance, rank, a, b``: candidate pairs with ``columns`` of both facts.

    The same pairs as ``candidate_pairs`` of the facts, in one shuffle of the facts by their block.
    """
    needed = ["id", "doc_id", "ingest_seq", "claim_text", *(match or MATCH)]
    if "attribute_key" in needed:
        facts = facts.withColumn("attribute_key", attribute_key(F.col("attribute")))
    rows = facts.select(*dict.fromkeys([*needed, *columns]))
    pairs = nearest_in_blocks(
        rows, top_k, match=match or MATCH, differ="doc_id", earlier="ingest_seq", embed=embed_claims, columns=columns
    )
    return pairs.withColumnsRenamed({"query_id": "fact_a_id", "base_id": "fact_b_id"}).where("fact_a_id <> fact_b_id")


def related_edges(facts: DataFrame, columns: list[str] = [], top_k: int = TOP_K) -> DataFrame:  # noqa: B006
    """Informative edges by rule, with ``block`` and both facts as structs ``a`` and ``b``."""
    pairs = related_facts(facts, list(dict.fromkeys([*RULE_COLUMNS, *columns])), top_k)
    return informative(rule_edges(pairs, "block", "a", "b"))


def agreeing(facts: DataFrame) -> DataFrame:
    """``id, cluster_id``: the ``agreement_clusters`` of the facts and their edges, settled block by block."""
    agreed = related_edges(facts).where(F.col("relation") == "corroborate")
    pairs = agreed.select("block", F.col("fact_a_id").alias("u"), F.col("fact_b_id").alias("v"))
    return clusters_of(facts, components_in_blocks(pairs))


def edges_around(facts: DataFrame, doc_id: str) -> DataFrame:
    """Edges that have a fact of the document: only facts that can be related to one of its facts are searched."""
    keyed = facts.withColumn("attribute_key", attribute_key(F.col("attribute")))
    own = keyed.where(F.col("doc_id") == doc_id).select(*[F.col(c).alias(f"_{c}") for c in MATCH]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in MATCH]
    return build_edges(materialize(keyed.join(own, same, "left_semi").drop("attribute_key"), "around"))


def build_edges(
    facts: DataFrame,
    known: DataFrame | None = None,
    judge: Callable[[DataFrame, DataFrame], DataFrame] = adjudicate_by_rules,
    top_k: int = TOP_K,
    match: list[str] | None = None,
    **options,
) -> DataFrame:
    """Informative edges from each fact to its nearest earlier facts of other documents.

    ``known`` are the facts to search in (default: the facts themselves); ``match=[]`` searches
    across subjects as well.
    """
    if known is None and judge is adjudicate_by_rules and match is None and not options:
        return related_edges(facts, top_k=top_k).drop("block", "a", "b")
    base = None if known is None else searchable(known)
    pairs = candidate_pairs(searchable(facts), base, top_k, match=MATCH if match is None else match, **options)
    # A fact that is sent again counts with its newest version.
    involved = facts if known is None else upsert_by_id(known.withColumn("version", F.lit(0)), facts.withColumn("version", F.lit(1)))
    return informative(judge(pairs, involved))
