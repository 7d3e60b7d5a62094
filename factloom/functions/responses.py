"""Tolerant reading of model responses: fences, JSON arrays and objects, row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import let, normal_span, span_grounded, strip
from factloom.schemas import CLAIM_FIELDS, DIMENSIONS, RELATIONS


def strip_fences(response: Column) -> Column:
    """Drop an opening code-fence line and the closing fence."""
    text = strip(response)
    opened = F.regexp_replace(text, r"^```[^\n]*\n", "")
    bare_fence = text.startswith("```") & ~F.contains(text, F.lit("\n"))
    closed = F.regexp_replace(opened, r"(?U)```\s*$", "")
    return (
        F.when(bare_fence, F.lit("")).when(text.startswith("```"), closed).otherwise(text)
    )


def _as_list(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")


def closing_bracket(text: Column) -> Column:
    """Place (from 1) of the ``]`` that closes the ``[`` at the start of ``text``, 0 if none does.

    One fold over the characters that count, each with the ordinary ones after it: nesting depth, inside a
    string or not, after a backslash or not. A backslash with more behind it has escaped what is no sign.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end")
    )

    def step(s: Column, piece: Column) -> Column:
        c = F.substring(piece, 1, 1)
        turn = F.when(s.quoted, 0).when(c == "[", 1).when(c == "]", -1).otherwise(0)
        depth = s.depth + turn
        after = F.struct(
            (s.at + F.length(piece)).alias("at"),
            depth.alias("depth"),
            F.when((c == '"') & ~s.escaped, ~s.quoted).otherwise(s.quoted).alias("quoted"),
            (s.quoted & (piece == "\\") & ~s.escaped).alias("escaped"),
            F.when((turn == -1) & (depth == 0), s.at + 1).otherwise(0).alias("end"),
        )
        return F.when(s.end > 0, s).otherwise(after)

    return F.aggregate(F.split(text, r'(?=["\[\]\\])'), start, step, lambda s: s.end)


def json_rows(response: Column) -> Column:
    """``array<variant>`` of a response, null when there is none.

    The array that begins at the first ``[`` is taken, whatever stands around it; a bracket inside
    a string does no harm. Without one, the first list among an object's values (by key). Linear in
    the length of the response.
    """

    def find(text: Column) -> Column:
        start = F.locate("[", text)
        end = F.length(text) - F.locate("]", F.reverse(text)) + 1
        tail = F.substring(text, start, F.length(text))
        outer = _as_list(F.substring(text, start, F.greatest(end - start + 1, F.lit(0))))
        # What a reply ends with after its array may hold brackets too.
        shorter = _as_list(F.substring(tail, F.lit(1), closing_bracket(tail)))
        fields = F.map_values(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"))
        lists = F.filter(fields, lambda v: F.schema_of_variant(v).startswith("ARRAY"))
        listed = F.try_variant_get(F.get(lists, F.lit(0)), "$", "array<variant>")
        return F.coalesce(F.when(start > 0, outer), F.when(start > 0, shorter), listed)

    return let(strip_fences(response), find)


def valid_rows(rows: Column) -> Column:
    """Keep the elements that are objects with all claim fields; a null value counts as present."""
    needed = F.array(*[F.lit(name) for name in CLAIM_FIELDS])

    def complete(row: Column) -> Column:
        keys = F.map_keys(F.try_variant_get(row, "$", "map<string,variant>"))
        return F.size(F.array_except(needed, keys)) == 0

    return F.filter(
        rows, lambda r: F.coalesce(F.schema_of_variant(r).startswith("OBJECT") & complete(r), F.lit(False))
    )


def claim_fields(row: Column) -> dict[str, Column]:
    """Typed fields of one claim row; unreadable confidence is 0.5, a non-list scope is empty."""

    def text(name: str) -> Column:
        return F.try_variant_get(row, f"$.{name}", "string")

    scope = F.try_variant_get(row, "$.scope_qualifiers", "array<string>")
    fields = {name: text(name) for name in CLAIM_FIELDS}
    fields["scope_qualifiers"] = F.coalesce(scope, F.expr("cast(array() as array<string>)"))
    fields["confidence"] = F.coalesce(F.try_variant_get(row, "$.confidence", "double"), F.lit(0.5))
    return fields


def response_claims(responses: DataFrame, keep: list[str], *, allow_blank: bool = False) -> DataFrame:
    """Grounded claims of ``response`` rows against ``chunk_text``; ``row_pos`` is the array place."""
    spans = responses.withColumn("chunk_span", normal_span(F.col("chunk_text")))
    rows = spans.select(
        *keep, "chunk_span", F.posexplode(valid_rows(json_rows(F.col("response")))).alias("row_pos", "_row")
    )
    claims = rows.select(
        *keep, "chunk_span", "row_pos", *[c.alias(n) for n, c in claim_fields(F.col("_row")).items()]
    )
    grounded = span_grounded(F.col("chunk_span"), F.col("evidence_span"), allow_blank=allow_blank)
    return claims.where(grounded).drop("chunk_span")


def json_object(text: Column) -> Column:
    """The text as a JSON object, else its part from the first ``{`` to the last ``}``.

    Each reading is made once, and none of a text that cannot be an object as it is.
    """
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    bare = strip(text)
    whole = F.when(bare.startswith("{"), F.try_parse_json(bare))
    inner = let(F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)), lambda v: F.when(is_object(v), v))
    return let(whole, lambda v: F.when(is_object(v), v).otherwise(inner))


def adjudication(response: Column) -> Column:
    """struct(relation, reasoning, reconciling_dimension, confidence), null when unusable.

    Unknown relations and unreadable confidences drop the pair, an unknown dimension is ``none``,
    a missing confidence is 0.
    """

    def read(v: Column) -> Column:
        relation = F.try_variant_get(v, "$.relation", "string")
        dimension = F.try_variant_get(v, "$.reconciling_dimension", "string")
        given = F.try_variant_get(v, "$.confidence", "variant")
        confidence = F.when(given.isNull(), F.lit(0.0)).otherwise(
            F.try_variant_get(v, "$.confidence", "double")
        )
        return F.when(
            relation.isin(RELATIONS) & confidence.isNotNull(),
            F.struct(
                relation.alias("relation"),
                F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("")).alias("reasoning"),
                F.when(dimension.isin(DIMENSIONS), dimension)
                .otherwise(F.lit("none"))
                .alias("reconciling_dimension"),
                confidence.alias("confidence"),
            ),
        )

    return let(json_object(response), read)
