"""Text expressions: whitespace, token sets, span overlap, grounding, headings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters Python counts as white space.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_RUN = r"(?U)[\s\x1c-\x1f]+"  # the same characters

HEADING_MAX = 60
HEADING_ENDINGS = r"[.,;:?!]$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use in ``body`` (lambda bodies would evaluate it per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def collapse(text: Column) -> Column:
    """Trim and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(text, _RUN, " "))


def normal_span(text: Column) -> Column:
    return F.lower(collapse(text))


def token_set(span: Column) -> Column:
    """Distinct tokens of a normalised span; the empty span has none."""
    return F.array_distinct(F.filter(F.split(span, " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets; two empty sets are equal (1.0)."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def sets_similar(a: Column, b: Column) -> Column:
    """Jaccard of at least 4/5; sets of too different size are told apart without comparing them."""
    n, m = F.size(a), F.size(b)
    # shared / (n + m - shared) >= 4 / 5, with the intersection, which costs most, written once.
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (F.size(F.array_intersect(a, b)) * 9 >= (n + m) * 4)


def spans_overlap(span_a: Column, tokens_a: Column, span_b: Column, tokens_b: Column) -> Column:
    """Near-duplicate test: similar token sets, or one span inside the other."""
    inside = F.contains(span_a, span_b) | F.contains(span_b, span_a)
    return inside | sets_similar(tokens_a, tokens_b)


def is_grounded(chunk_text: Column, evidence: Column, *, allow_blank: bool = False) -> Column:
    """True when the evidence occurs verbatim in the chunk, white space and case aside.

    Blank evidence is rejected; with ``allow_blank`` evidence made only of white space passes,
    the empty string never does.
    """
    return span_grounded(normal_span(chunk_text), evidence, allow_blank=allow_blank)


def span_grounded(chunk_span: Column, evidence: Column, *, allow_blank: bool = False) -> Column:
    """:func:`is_grounded` for a chunk that is normalised already, once for all of its claims."""
    required = evidence if allow_blank else strip(evidence)
    return F.coalesce(F.contains(chunk_span, normal_span(evidence)) & (required != ""), F.lit(False))


def section_hint(page_text: Column) -> Column:
    """First line of a page when it looks like a heading, else the empty string."""
    first = strip(F.substring_index(page_text, "\n", 1))
    heading = F.length(first).between(1, HEADING_MAX) & ~first.rlike(HEADING_ENDINGS)
    return F.when(heading, first).otherwise(F.lit(""))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def render_table(rows: Column) -> Column:
    """``array<array<string>>`` to text: cells by `` | ``, null cells empty, a newline per row."""
    lines = F.transform(rows, lambda cells: F.array_join(cells, " | ", ""))
    return F.when(F.size(rows) == 0, F.lit("")).otherwise(
        F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    )
