import pytest
from pyspark.sql import functions as F

from factloom.functions.text import is_grounded, jaccard, render_table, section_hint, spans_overlap, strip, token_set
from factloom.operators import chunking
from factloom.operators.chunking import chunk_blocks, chunk_documents, merge_pages, sliding_chunks
from factloom.sources.blocks import (
    first_per_folder, html_blocks, page_counts, parse_with, read_files, running_offsets, table_blocks, text_blocks, text_pages,
)

BLOCK = "doc_id string, page int, block_no int, text string, char_start long, char_end long, kind string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def block(page, no, text, start, doc="d1"):
    return (doc, page, no, text, start, start + len(text), "text")


def test_chunks_stay_on_their_page_and_within_size(spark):
    blocks = spark.createDataFrame(
        [block(1, 1, "A" * 1000, 0), block(1, 2, "B" * 1000, 1000), block(2, 1, "C" * 500, 2000)], BLOCK)
    chunks = chunk_blocks(blocks, 1200, 100).collect()
    assert {c.page for c in chunks} == {1, 2}
    assert all(len(c.text) <= 1200 and c.char_end - c.char_start == len(c.text) for c in chunks)
    assert not any("C" in c.text and ("A" in c.text or "B" in c.text) for c in chunks)


@pytest.mark.parametrize("long_page", [0, 1 << 16])
@pytest.mark.parametrize("size,overlap,length", [(500, 50, 1300), (500, 0, 1000), (10, 20, 35), (7, 3, 7), (5, 4, 23)])
def test_windows_equal_a_plain_loop(spark, monkeypatch, size, overlap, length, long_page):
    monkeypatch.setattr(chunking, "LONG_PAGE", long_page)
    text = "".join("\n" if i % 9 == 4 else chr(0x1F600 + i % 26) for i in range(length))
    expected, pos = [], 0
    while True:
        end = min(pos + size, length)
        expected.append((pos + 40, end + 40, text[pos:end]))
        if end == length:
            break
        pos += max(1, size - overlap)
    pages = spark.createDataFrame([("d", 1, text, 40)], "doc_id string, page int, text string, char_start long")
    got = sliding_chunks(pages, size, overlap).orderBy("chunk_no").collect()
    assert [(c.char_start, c.char_end, c.text) for c in got] == expected


def test_small_blocks_make_one_chunk_and_exact_offsets(spark):
    blocks = spark.createDataFrame([block(1, i, "X" * 100, 100 * (i - 1)) for i in range(1, 6)], BLOCK)
    (chunk,) = chunk_blocks(blocks, 1200, 0).collect()
    assert (chunk.char_start, chunk.char_end) == (0, 504)
    exact = sliding_chunks(merge_pages(blocks), 150, 0, exact_offsets=True).orderBy("chunk_no").collect()
    assert [(c.char_start, c.char_end) for c in exact][:2] == [(0, 149), (149, 298)]
    assert exact[-1].char_end == 500


def test_headings(spark):
    for text, hint in [("Revenue Summary\nThe company", "Revenue Summary"), ("A line of prose that ends.\nx", ""),
                       ("x" * 61 + "\ny", ""), ("  \ny", ""), ("Only", "Only")]:
        assert one(spark, section_hint(F.lit(text))) == hint


def test_text_pages_blocks_and_counts(spark):
    docs = spark.createDataFrame([("d", "a\n\nbb\n\fccc\n  \n\f\n")], "doc_id string, text string")
    got = [(b.page, b.block_no, b.text, b.char_start, b.char_end) for b in text_blocks(docs).collect()]
    assert got == [(1, 1, "a", 0, 1), (1, 2, "bb", 1, 3), (2, 1, "ccc", 3, 6)]
    assert page_counts(text_pages(docs)).first().num_pages == 3
    assert [c.text for c in chunk_documents(docs).orderBy("page").collect()] == ["a\nbb", "ccc"]


def test_hot_document_offsets(spark):
    rows = [("hot", 1 + i // 500, i % 500, "x" * (i % 7 + 1), "table" if i % 500 > 490 else "text") for i in range(3000)]
    blocks = spark.createDataFrame(rows, "doc_id string, page int, block_no int, text string, kind string")
    got = {(r.page, r.kind, r.block_no): r.char_start for r in running_offsets(blocks, width=64).collect()}
    total = 0
    for doc, page, no, text, kind in sorted(rows, key=lambda r: (r[1], r[4] == "table", r[2])):
        assert got[page, kind, no] == total
        total += len(text)


def test_tables_and_html(spark):
    rows = F.array(F.array(F.lit("a"), F.lit(None).cast("string")), F.array(F.lit("1"), F.lit("2")))
    assert one(spark, render_table(rows)) == "a | \n1 | 2\n"
    assert one(spark, render_table(F.expr("cast(array() as array<array<string>>)"))) == ""
    empty = spark.range(1).select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("block_no"),
                                  F.expr("cast(array() as array<array<string>>)").alias("rows"))
    assert table_blocks(empty).count() == 0
    html = ("<head><title>no</title></head><nav><p>no</p><script>no</script></nav><h1>T <b>x</b></h1><script>'<p>no</p>'</script>"
            "<p class='a'> one </p><!--<p>no</p>--><li>Intro <p>inner</p> tail 5 million</li><h2>Head two</h2><td>A &amp;lt; B</td>loose<p> </p>")
    got = html_blocks(spark.createDataFrame([("d", html)], "doc_id string, html string")).collect()
    assert [b.text for b in got] == ["T  x", "one", "Intro", "inner", "tail 5 million", "Head two", "A &lt; B", "loose"]


def test_parser_hook_isolates_failures(spark, tmp_path):
    (tmp_path / "a.txt").write_text("good")
    (tmp_path / "b.txt").write_text("bad")
    files = read_files(spark, str(tmp_path))

    def parse(_doc, content):
        def tables():
            if content == b"bad":
                raise ValueError("broken table")
            return [[["k", None]]]

        yield 1, [content.decode(), "  "], tables
        yield 2, ["second"], []

    rows = parse_with(files, parse).collect()
    assert {r.error for r in rows} == {None, "broken table"}
    assert sorted(r.text for r in rows if r.text) == ["bad", "good", "k | \n", "second", "second"]
    assert len({r.doc_id for r in rows}) == 2


def test_first_files(spark):
    files = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c"), ("x", "c")], "folder string, name string")
    got = first_per_folder(files, "folder", "name", 2).collect()
    assert sorted((r.folder, r.name) for r in got) == [("x", "a"), ("x", "b"), ("y", "c")]


def test_grounding(spark):
    text = F.lit("Revenue was Rs 8,142 crore\n in FY24. The sky is blue.")
    for evidence, expected in [("Revenue was Rs 8,142 crore in FY24", True), ("NOT IN TEXT", False), ("", False),
                               ("REVENUE   was\trs 8,142", True), ("  \n", False)]:
        assert one(spark, is_grounded(text, F.lit(evidence))) is expected
    assert one(spark, is_grounded(text, F.lit("  "), allow_blank=True)) is True
    assert one(spark, strip(F.lit(" \t x y \n"))) == "x y"


def test_similarity(spark):
    empty = token_set(F.lit(""))
    assert one(spark, jaccard(empty, empty)) == 1.0
    a, b = token_set(F.lit("a b c d")), token_set(F.lit("a b c d e"))
    assert one(spark, jaccard(a, b)) == 0.8
    assert one(spark, spans_overlap(F.lit("a b c d"), a, F.lit("e d c b a"), b)) is True
    assert one(spark, spans_overlap(F.lit("x"), token_set(F.lit("x")), F.lit("y"), token_set(F.lit("y")))) is False
