"""Page merge and the overlapping sliding window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import let, section_hint
from factloom.sources.blocks import text_pages

MAX_CHARS = 1200
OVERLAP = 150
LONG_PAGE = 1 << 16


def merge_pages(blocks: DataFrame) -> DataFrame:
    """Blocks of one page joined by newlines; the start is that of the first block."""
    order = F.struct((F.col("kind") == "table").cast("int").alias("table"), "block_no", "text", "char_start")
    ordered = F.array_sort(F.collect_list(order))
    return (
        blocks.groupBy("doc_id", "page")
        .agg(ordered.alias("b"))
        .select(
            "doc_id",
            "page",
            F.array_join(F.col("b.text"), "\n").alias("text"),
            F.col("b")[0]["char_start"].alias("char_start"),
        )
    )


def merged_text_pages(documents: DataFrame, lines_per_page: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Same rows as ``merge_pages(text_blocks(..))`` for line text, but without any shuffle.

    ``keep`` are columns of the documents that their pages carry on.
    """
    pages = text_pages(documents, lines_per_page, keep).where(F.size("lines") > 0)
    return pages.select("doc_id", "page", F.array_join("lines", "\n").alias("text"), "char_start", *keep)


def _starts(length: Column, max_chars: int, step: int) -> Column:
    last = F.ceil((length - max_chars) / step) * step
    return F.when(length <= max_chars, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)), F.lit(step).cast("long"))
    )


def chunk_position(position: Column, length: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Start of the last window of a page of ``length`` characters that starts at or before ``position``."""
    step = max(1, max_chars - overlap)
    last = F.greatest(F.ceil((length - max_chars) / step), F.lit(0))
    return F.least(F.floor(position / step), last) * step


def _windows(text: Column, max_chars: int, overlap: int, step: int) -> Column:
    """Texts of all windows. Long pages are cut into steps in one pass, as seeking each window from
    the start of the text would take quadratic time; a window is its step and the head of the next."""
    starts = _starts(F.length(text), max_chars, step)
    sought = F.transform(starts, lambda p: F.substring(text, (p + 1).cast("int"), F.lit(max_chars)))
    if overlap > step:
        return sought

    def joined(pieces: Column) -> Column:
        head = lambda i: F.coalesce(F.substring(F.get(pieces, i + 1), 1, overlap), F.lit(""))
        return F.transform(F.slice(pieces, F.lit(1), F.size(starts)), lambda p, i: F.concat(p, head(i)))

    cut = let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0)), joined)
    return F.when(F.length(text) <= LONG_PAGE, sought).otherwise(cut)


def sliding_chunks(
    pages: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, exact_offsets: bool = False
) -> DataFrame:
    """Windows of at most ``max_chars`` that overlap and never leave their page.

    Offsets are the page start plus the position in the merged text. As block offsets do not
    count the joining newlines, they drift by one per earlier line of the page;
    ``exact_offsets`` takes the newlines out again.
    """
    if overlap < 0 or max_chars < 1:
        raise ValueError("max_chars must be positive and overlap not negative")
    step = max(1, max_chars - overlap)
    windows = pages.select(
        "doc_id",
        "page",
        F.col("text").alias("_page_text"),
        F.col("char_start").alias("_base"),
        section_hint(F.col("text")).alias("section_hint"),
        F.posexplode(_windows(F.col("text"), max_chars, overlap, step)).alias("chunk_no", "text"),
    ).withColumn("_pos", F.col("chunk_no").cast("long") * step)
    start = F.col("_base") + F.col("_pos")
    end = start + F.length("text")
    if exact_offsets:
        seen = F.substring(F.col("_page_text"), F.lit(1), F.col("_pos").cast("int"))
        newlines = F.length(seen) - F.length(F.replace(seen, F.lit("\n"), F.lit("")))
        inner = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
        start = start - newlines
        end = start + F.length("text") - inner
    return windows.select(
        "doc_id",
        "page",
        "chunk_no",
        "text",
        start.alias("char_start"),
        end.alias("char_end"),
        "section_hint",
    )


def chunk_blocks(blocks: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    return sliding_chunks(merge_pages(blocks), max_chars, overlap)


def chunk_documents(
    documents: DataFrame,
    max_chars: int = MAX_CHARS,
    overlap: int = OVERLAP,
    lines_per_page: int | None = None,
) -> DataFrame:
    """Chunks of ``doc_id, text`` rows in one narrow stage."""
    return sliding_chunks(merged_text_pages(documents, lines_per_page), max_chars, overlap)
