"""Claims from chunks: a pattern backend in columns, and the caller's model as the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.responses import json_rows, response_claims
from factloom.functions.text import let, strip
from factloom.operators.chunking import MAX_CHARS, OVERLAP, chunk_position
from factloom.operators.requests import THREADS, ask_cached, request_key
from factloom.sources.blocks import running_starts

_PERIOD = r"(?:Q[1-4])?FY[0-9]{2,4}|CY[0-9]{4}|[0-9]{4}"
_NUMERIC = (
    r"^(.+?) ([a-z][a-z_-]*) (?:was|were|is|are) (?:(about|around|approximately) )?"
    r"([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)(?: ?(%)| ([^\n(]+?))??"
    rf"(?: (?:in|for) ({_PERIOD})| (as of [0-9/-]+))?(?: \(([^\n()]+)\))?\.$"
)
_STATEMENT = (
    r"^(.+?) ([a-z][a-z_-]*) (?:was|is) ([A-Z][^\n(]*?)"
    rf"(?: (?:in|for) ({_PERIOD})| (as of [0-9/-]+))?(?: \(([^\n()]+)\))?\.$"
)

SYSTEM = (
    "List every checkable claim of the text as a JSON array. Each element has the keys subject, "
    "attribute, value, unit, temporal_context, scope_qualifiers (list), evidence_span (copied word "
    "for word from the text), claim_text (one full sentence), fact_kind (numerical or semantic) and "
    "confidence (0 to 1). Answer with the array only."
)


def _in_order(claims: DataFrame) -> DataFrame:
    """Content-derived id, and ``seq``: the order (page, chunk start, place in chunk) as one number."""
    place = F.concat_ws("\0", "doc_id", "page", "char_start", "row_pos")
    seq = F.col("char_start") * F.lit(1 << 20) + F.col("row_pos")
    return claims.withColumn("id", F.concat(F.lit("fact_"), F.substring(F.sha2(place, 256), 1, 32))).withColumn(
        "seq", seq.cast("long")
    )


def pattern_claims(
    pages: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Claims stated one per line: ``<subject> <attribute> was <value> <unit> in <period> (scope).``

    Lines are taken from the pages, so that none is lost or cut where a chunk ends, however long it is;
    each counts for the last chunk that starts at or before it. A line is text of its page, so it is
    grounded there. The whole stage is a projection. ``keep`` are columns of the pages that go with each claim.
    """
    lines = F.split("text", "\n")
    # Each line is matched once and turned into its parts: kind, line, then the groups in order.
    numeric = "\1".join(["n", "$0", "$1", "$2", "$3", "$4", "$5$6", "$7$8", "$9"])
    statement = "\1".join(["s", "$0", "$1", "$2", "", "$3", "", "$4$5", "$6"])

    def parts_of(line: Column) -> Column:
        # A line that matches grows by its parts, so one pass both tests and takes it apart.
        def stated_or(found: Column, other: Column) -> Column:
            return F.when(F.length(found) > F.length(line), found).otherwise(other)

        no_claim = F.lit(None).cast("string")
        later = let(F.regexp_replace(line, _STATEMENT, statement), lambda found: stated_or(found, no_claim))
        return F.split(let(F.regexp_replace(line, _NUMERIC, numeric), lambda found: stated_or(found, later)), "\1")

    sizes = F.transform(lines, lambda x: (F.length(x) + 1).cast("long"))
    placed = F.arrays_zip(F.transform(lines, lambda x: let(strip(x), parts_of)).alias("parts"), running_starts(sizes).alias("at"))
    stated = F.filter(placed, lambda x: x.parts.isNotNull())
    rows = pages.select("doc_id", *keep, "page", "char_start", F.length("text").alias("_size"), F.posexplode(stated).alias("row_pos", "x"))
    start = F.col("char_start") + chunk_position(F.col("x.at"), F.col("_size"), max_chars, overlap)
    rows = rows.select("doc_id", *keep, "page", start.cast("long").alias("char_start"), "row_pos", F.col("x.parts").alias("p"))
    kind, line, subject, attribute, hedge, value, unit, period, scope = [F.col("p")[i] for i in range(9)]
    confidence = (
        F.when(kind == "s", 0.75).when(hedge != "", 0.7).when((unit != "") & (period != ""), 0.95).otherwise(0.8)
    )
    claims = rows.select(
        "doc_id",
        "page",
        "char_start",
        "row_pos",
        subject.alias("subject"),
        attribute.alias("attribute"),
        value.alias("value"),
        unit.alias("unit"),
        period.alias("temporal_context"),
        F.filter(F.split(scope, ", *"), lambda q: q != "").alias("scope_qualifiers"),
        line.alias("evidence_span"),
        line.alias("claim_text"),
        F.when(kind == "n", "numerical").otherwise("semantic").alias("fact_kind"),
        confidence.alias("confidence"),
        *keep,
    )
    return _in_order(claims)


def extraction_requests(chunks: DataFrame, model: str = "model") -> DataFrame:
    """Chunks with ``system``, ``user`` and the cache key of the request."""
    user = F.concat(F.lit("Text:\n\n"), F.col("text"), F.lit("\n\nAnswer with the JSON array."))
    return chunks.withColumn("system", F.lit(SYSTEM)).withColumn("user", user).withColumn(
        "key", request_key(model, F.col("system"), F.col("user"))
    )


def model_claims(
    chunks: DataFrame,
    complete: Callable[[str, str], str],
    *,
    concurrency: int | None = None,
    threads: int = THREADS,
    cache: DataFrame | None = None,
    model: str = "model",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grounded claims, chunk report, new cache rows): each distinct request is asked once.

    ``concurrency`` is the number of tasks that ask (by default the requests keep their partitions) and
    ``threads`` the number of calls that a task has open.
    """
    requests = extraction_requests(chunks, model)
    answers, fresh = ask_cached(requests, complete, cache, concurrency, threads)
    answered = requests.drop("system", "user").join(answers, "key")
    claims = response_claims(
        answered.withColumnRenamed("text", "chunk_text"), ["doc_id", "page", "char_start"]
    )
    return _in_order(claims), chunk_report(answered), fresh


def chunk_report(answered: DataFrame) -> DataFrame:
    """Per document: chunks, failed chunks, raw rows; ``no_facts`` marks documents without any."""
    raw = F.coalesce(F.size(json_rows(F.col("response"))), F.lit(0))
    raw = F.when(F.col("response").isNull(), 0).otherwise(F.greatest(raw, F.lit(0)))
    report = answered.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"),
        F.count_if(F.col("error").isNotNull()).alias("n_failed"),
        F.sum(raw).alias("n_raw"),
    )
    return report.withColumn("no_facts", (F.col("n_chunks") > 0) & (F.col("n_raw") == 0))
