"""Page blocks from line text, HTML, cell tables and caller-parsed files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factloom.functions.text import content_hash, let, render_table, strip

# Elements whose content is not text, elements that start and end blocks, and named characters.
_DROPPED = r"(?is)<!--.*?-->|" + "|".join(rf"<{e}\b[^>]*>.*?</{e}\s*>" for e in ("script", "style", "nav", "head"))
_BLOCK_TAG = (
    r"(?is)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html"
    r"|li|main|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>"
)
_TAG = r"(?s)<[^>]*>"
_NAMED = (
    ("&nbsp;", "\u00a0"), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&mdash;", "\u2014"), ("&ndash;", "\u2013"),
    ("&hellip;", "\u2026"), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
)


def decode_numbered(text: Column) -> Column:
    """Numeric character references, decimal or hexadecimal, as their characters.

    Numbers that name no character stay as they are; zero becomes the replacement character.
    """

    def letter(piece: Column) -> Column:
        body = F.regexp_extract(piece, r"^(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});", 1)
        number = F.when(body.startswith("x"), F.conv(F.substring(body, 2, 6), 16, 10)).otherwise(body).try_cast("int")
        number = F.when(number == 0, 0xFFFD).otherwise(number)
        valid = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        rest = F.substring(piece, F.length(body) + 2, F.length(piece))
        return F.when((body != "") & F.coalesce(valid, F.lit(False)), F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), piece))

    def joined(pieces: Column) -> Column:
        later = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), letter)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(later, ""))

    return F.when(F.contains(text, F.lit("&#")), let(F.split(text, "&#"), joined)).otherwise(text)


def running_starts(sizes: Column) -> Column:
    """Exclusive running sums of an ``array<long>``."""
    empty = F.expr("cast(array() as array<bigint>)")
    return F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("long").alias("total"), empty.alias("starts")),
        lambda acc, n: F.struct(
            (acc.total + n).alias("total"), F.array_append(acc.starts, acc.total).alias("starts")
        ),
        lambda acc: acc.starts,
    )


def text_pages(documents: DataFrame, lines_per_page: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Split ``doc_id, text`` into pages at form feeds, and after every ``lines_per_page`` lines.

    One row in, its pages out: a narrow projection without a shuffle. Each page carries its
    non-blank lines (the blocks), ``char_start``, the total length of the lines before it, and the columns
    ``keep`` of its document.
    """
    lines = lambda page: F.split(page, "\n")
    sheets = F.split("text", "\f")
    if lines_per_page is None:
        pages = F.transform(sheets, lines)
    else:

        def cut(sheet: Column) -> Column:
            rows = lines(sheet)
            starts = F.sequence(F.lit(1), F.size(rows), F.lit(lines_per_page))
            return F.transform(starts, lambda s: F.slice(rows, s, F.lit(lines_per_page)))

        pages = F.flatten(F.transform(sheets, cut))
    kept = F.transform(pages, lambda rows: F.filter(rows, lambda r: strip(r) != ""))
    sizes = F.transform(
        F.col("_pages"), lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda n, r: n + F.length(r))
    )
    starts = running_starts(sizes)
    numbered = documents.select("doc_id", *keep, kept.alias("_pages")).select(
        "doc_id", *keep, F.posexplode(F.arrays_zip(F.col("_pages").alias("lines"), starts.alias("starts")))
    )
    return numbered.select(
        "doc_id",
        (F.col("pos") + 1).alias("page"),
        F.col("col.lines").alias("lines"),
        F.col("col.starts").alias("char_start"),
        *keep,
    )


def text_blocks(documents: DataFrame, lines_per_page: int | None = None) -> DataFrame:
    """One block per non-blank line, with document offsets, still without a shuffle."""
    lines = text_pages(documents, lines_per_page)
    sizes = F.transform("lines", lambda r: F.length(r).cast("long"))
    zipped = F.arrays_zip(F.col("lines").alias("text"), running_starts(sizes).alias("start"))
    return (
        lines.select("doc_id", "page", "char_start", F.posexplode(zipped).alias("pos", "block"))
        .withColumn("char_start", F.col("char_start") + F.col("block.start"))
        .select(
            "doc_id",
            "page",
            (F.col("pos") + 1).alias("block_no"),
            F.col("block.text").alias("text"),
            "char_start",
            (F.col("char_start") + F.length("block.text")).alias("char_end"),
            F.lit("text").alias("kind"),
        )
    )


def page_counts(pages: DataFrame) -> DataFrame:
    """Number of pages per document, blank pages included."""
    return pages.groupBy("doc_id").agg(F.max("page").alias("num_pages"))


def html_blocks(pages: DataFrame, doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """Blocks of raw pages: all visible text, cut at the tags of block elements, however they are nested.

    Comments, scripts, styles, navigation and the head are left out, other tags become blanks, and named
    and numbered characters are decoded.
    """
    body = F.regexp_replace(F.regexp_replace(html, _DROPPED, ""), _BLOCK_TAG, "\1")

    def plain(text: Column) -> Column:
        text = decode_numbered(F.regexp_replace(text, _TAG, " "))
        for name, letter in _NAMED:
            text = F.replace(text, F.lit(name), F.lit(letter))
        return strip(text)

    texts = F.transform(F.split(body, "\1"), plain)
    return pages.select(
        F.col(doc_id).cast("string").alias("doc_id"),
        F.lit(1).alias("page"),
        F.posexplode(F.filter(texts, lambda t: t != "")).alias("pos", "text"),
    ).select(
        "doc_id",
        "page",
        (F.col("pos") + 1).alias("block_no"),
        "text",
        F.lit("text").alias("kind"),
    )


def table_blocks(tables: DataFrame) -> DataFrame:
    """``doc_id, page, block_no, rows`` cell tables as rendered blocks; empty ones are dropped."""
    return tables.select(
        "doc_id", "page", "block_no", render_table(F.col("rows")).alias("text"), F.lit("table").alias("kind")
    ).where(strip(F.col("text")) != "")


def running_offsets(blocks: DataFrame, width: int = 1024) -> DataFrame:
    """Add ``char_start``/``char_end``: lengths of the earlier blocks of the document.

    Order within a document is page, text before tables, block number. The prefix sum runs in
    three levels (ranges of pages, ranges of blocks, blocks), so that no window partition holds a
    whole document: the sums of the upper levels are combined map-side and joined back.
    """
    keyed = blocks.withColumns(
        {
            "_pages": F.floor(F.col("page") / width),
            "_table": (F.col("kind") == "table").cast("int"),
            "_slot": F.floor(F.col("block_no") / width),
        }
    )
    top = ["doc_id", "_pages"]
    middle = [*top, "page", "_table", "_slot"]
    size = F.sum(F.length("text"))

    def before(level: Window) -> Column:
        return F.coalesce(F.sum("_size").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    slots = keyed.groupBy(*middle).agg(size.alias("_size"))
    ranges = slots.groupBy(*top).agg(F.sum("_size").alias("_size"))
    ranges = ranges.withColumn("_before", before(Window.partitionBy("doc_id").orderBy("_pages"))).drop("_size")
    slots = (
        slots.withColumn("_inner", before(Window.partitionBy(*top).orderBy("page", "_table", "_slot")))
        .drop("_size")
        .join(ranges, top)
        .select(*middle, (F.col("_before") + F.col("_inner")).alias("_before"))
    )
    in_slot = Window.partitionBy(*middle).orderBy("block_no")
    return (
        keyed.withColumn("_size", F.length("text"))
        .withColumn("_inner", before(in_slot))
        .join(slots, middle)
        .withColumn("char_start", F.col("_before") + F.col("_inner"))
        .withColumn("char_end", F.col("char_start") + F.col("_size"))
        .drop("_pages", "_table", "_slot", "_size", "_inner", "_before")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``doc_id, filename, content`` rows; the id is the hash of the bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.concat(F.lit("doc_"), F.substring(content_hash(F.col("content")), 1, 32)).alias("doc_id"),
        F.col("path").alias("filename"),
        "content",
    )


def parse_with(
    files: DataFrame, parser: Callable[[str, bytes], Iterable[tuple[int, list[str], list[list[list]]]]]
) -> DataFrame:
    """Blocks by the caller's ``parser(doc_id, content) -> (page, texts, tables)`` per page.

    A page's texts come before its tables. ``texts`` and ``tables`` may be callables, evaluated
    one by one: a failure is reported in ``error`` for that page, and the rest goes on.
    """
    schema = "doc_id string, page int, block_no int, text string, kind string, error string"

    def run(batches):
        import pandas as pd

        def get(part):
            return part() if callable(part) else part

        def rows_of(doc_id, content):
            try:
                for page, texts, tables in parser(doc_id, content):
                    number = 0
                    for kind, part in (("text", texts), ("table", tables)):
                        try:
                            blocks = get(part)
                        except Exception as exc:  # noqa: BLE001
                            yield doc_id, page, None, None, kind, str(exc)
                            continue
                        for block in blocks:
                            if kind == "table":
                                lines = [" | ".join("" if c is None else str(c) for c in r) for r in block]
                                block = "\n".join(lines) + "\n" if lines else ""
                            if block.strip():
                                number += 1
                                yield doc_id, page, number, block, kind, None
            except Exception as exc:  # noqa: BLE001
                yield doc_id, None, None, None, None, str(exc)

        columns = [field.split()[0] for field in schema.split(", ")]
        for batch in batches:
            out = [row for pair in zip(batch.doc_id, batch.content) for row in rows_of(*pair)]
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"page": "Int32", "block_no": "Int32"})

    return files.select("doc_id", "content").mapInPandas(run, schema)


def first_per_folder(files: DataFrame, folder: str, name: str, n: int) -> DataFrame:
    """The first ``n`` files of every folder by name (the limit is the feature)."""
    rank = F.row_number().over(Window.partitionBy(folder).orderBy(name))
    return files.withColumn("position", rank).where(F.col("position") <= n)

