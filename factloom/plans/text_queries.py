"""Queries on documents and pages: blocks, offsets, chunks, grounding, near-duplicates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.text import (
    content_hash,
    jaccard,
    normal_span,
    section_hint,
    span_grounded,
    spans_overlap,
    token_set,
)
from factloom.operators.chunking import chunk_documents, merge_pages
from factloom.operators.dedupe import dedupe_facts, leader_clusters
from factloom.plans.claims import table
from factloom.plans.registry import query
from factloom.session import spread
from factloom.sources.blocks import (
    first_per_folder,
    html_blocks,
    page_counts,
    parse_with,
    running_offsets,
    table_blocks,
    text_blocks,
    text_pages,
)

LINES = 5

_LINES_SQL = r"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents),
blocks AS (
  SELECT doc_id, CAST((n - 1) // 5 + 1 AS INT) AS page, text, n,
         CAST(row_number() OVER (PARTITION BY doc_id, (n - 1) // 5 ORDER BY n) AS INT) AS block_no,
         CAST(coalesce(sum(length(text)) OVER (
           PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS BIGINT) AS char_start
  FROM lines WHERE regexp_matches(text, '\S'))
"""

_HTML_SQL = r"""
bodies AS (
  SELECT page_id, regexp_replace(regexp_replace(html,
    '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<nav\b[^>]*>.*?</nav\s*>|<head\b[^>]*>.*?</head\s*>', '', 'g'),
    '(?is)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>',
    chr(1), 'g') AS body
  FROM pages),
raw AS (
  SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS n
  FROM (SELECT page_id, string_split(body, chr(1)) AS x FROM bodies)),
stripped AS (
  SELECT page_id, n, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
           regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', chr(160)), '&middot;', chr(183)), '&copy;', chr(169)),
           '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS text
  FROM raw),
html_blocks AS (
  SELECT CAST(page_id AS VARCHAR) AS doc_id, 1 AS page, text,
         CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS INT) AS block_no
  FROM stripped WHERE text <> '')
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks(spread(table(spark, sf_dir, "pages").select("page_id", "html")), "page_id")


@query(
    f"""WITH {_LINES_SQL}
SELECT doc_id, page, block_no, text, char_start, char_start + length(text) AS char_end, 'text' AS kind
FROM blocks"""
)
def line_blocks(spark, sf_dir):
    return text_blocks(_documents(spark, sf_dir), LINES)


@query(f"WITH {_HTML_SQL} SELECT doc_id, page, block_no, text, 'text' AS kind FROM html_blocks")
def markup_blocks(spark, sf_dir):
    return _html(spark, sf_dir)


@query(
    f"""WITH {_HTML_SQL}
SELECT doc_id, page, block_no, char_start, char_start + size AS char_end FROM (
  SELECT doc_id, page, block_no, length(text) AS size,
         CAST(coalesce(sum(length(text)) OVER (
           PARTITION BY doc_id ORDER BY page, block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           0) AS BIGINT) AS char_start
  FROM html_blocks)"""
)
def block_offsets(spark, sf_dir):
    offsets = running_offsets(_html(spark, sf_dir), width=16)
    return offsets.select("doc_id", "page", "block_no", "char_start", "char_end")


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 1 AS page, 1 AS block_no, 'table' AS kind,
  string_agg(l_linenumber || ' | ' || CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END
             || ' | ' || CAST(l_quantity AS INT), chr(10) ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) || chr(10) AS text
FROM lineitem GROUP BY l_orderkey"""
)
def rendered_tables(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    cells = F.array(
        F.col("l_linenumber").cast("string"), flag, F.col("l_quantity").cast("int").cast("string")
    )
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag", cells.alias("cells"))))
    tables = lines.groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(rows.cells.alias("rows"))
    return table_blocks(tables.withColumns({"page": F.lit(1), "block_no": F.lit(1)}))


@query(
    """SELECT doc_id, CAST(ceil(len(string_split(text, chr(10))) / 5.0) AS INT) AS num_pages FROM documents"""
)
def document_page_counts(spark, sf_dir):
    return page_counts(text_pages(_documents(spark, sf_dir), LINES))


def _markup_parser(doc_id: str, content: bytes):
    """One page per file: paragraphs as texts; list items as a table, refused on unbalanced <b>."""
    html = content.decode("utf-8")

    def items():
        if html.count("<b>") != html.count("</b>"):
            raise ValueError("unbalanced <b>")
        return [[[item] for item in re.findall(r"<li>(.*?)</li>", html, re.S)]]

    return [(1, re.findall(r"<p>(.*?)</p>", html, re.S), items)]


@query(
    """SELECT CAST(page_id AS VARCHAR) AS doc_id, 1 AS page,
  CAST((length(html) - length(replace(html, '<b>', ''))) / 3
       <> (length(html) - length(replace(html, '</b>', ''))) / 4 AS INT) AS n_errors,
  CAST(len(list_filter(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda t: regexp_matches(t, '\\S')))
       AS BIGINT) AS n_texts
FROM pages""".replace("\\\\", "\\")
)
def page_failures(spark, sf_dir):
    """A failing table part is reported for its page, and the text of the page is kept."""
    files = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("doc_id"), F.encode("html", "utf-8").alias("content")
    )
    blocks = parse_with(files, _markup_parser)
    return blocks.groupBy("doc_id", "page").agg(
        F.count_if(F.col("error").isNotNull()).cast("int").alias("n_errors"),
        F.count_if((F.col("kind") == "text") & F.col("error").isNull()).alias("n_texts"),
    )


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", content_hash(F.encode("text", "utf-8")).alias("content_hash"))


@query(
    """SELECT source, name, position FROM (
  SELECT source, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS name,
         CAST(row_number() OVER (PARTITION BY source ORDER BY lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS INT) AS position
  FROM documents) WHERE position <= 3"""
)
def first_files_per_folder(spark, sf_dir):
    name = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    files = table(spark, sf_dir, "documents").select("source", name.alias("name"))
    return first_per_folder(files, "source", "name", 3)


@query(
    f"""WITH {_LINES_SQL}
SELECT doc_id, page, string_agg(text, chr(10) ORDER BY n) AS text, min(char_start) AS char_start
FROM blocks GROUP BY doc_id, page"""
)
def merged_pages(spark, sf_dir):
    return merge_pages(text_blocks(_documents(spark, sf_dir), LINES))


@query(
    r"""WITH joined AS (
  SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda t: regexp_matches(t, '\S')), chr(10)) AS text
  FROM documents),
starts AS (
  SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1200 THEN [0]
    ELSE range(0, CAST(ceil((length(text) - 1200) / 1050.0) AS BIGINT) * 1050 + 1, 1050) END) AS pos
  FROM joined WHERE text <> '')
SELECT doc_id, 1 AS page, CAST(pos // 1050 AS INT) AS chunk_no, substr(text, pos + 1, 1200) AS text,
  CAST(pos AS BIGINT) AS char_start, CAST(pos + length(substr(text, pos + 1, 1200)) AS BIGINT) AS char_end
FROM starts"""
)
def overlapping_chunks(spark, sf_dir):
    return chunk_documents(_documents(spark, sf_dir)).drop("section_hint")


@query(
    f"""WITH {_HTML_SQL}
SELECT doc_id, CASE WHEN length(h) BETWEEN 1 AND 60 AND NOT regexp_matches(h, '[.,;:?!]$') THEN h ELSE '' END
  AS section_hint
FROM (SELECT doc_id, regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g') AS h
      FROM html_blocks WHERE block_no = 1)"""
)
def page_headings(spark, sf_dir):
    merged = merge_pages(_html(spark, sf_dir).withColumn("char_start", F.lit(0).cast("long")))
    return merged.select("doc_id", section_hint(F.col("text")).alias("section_hint"))


_NORM_SQL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


@query(
    rf"""WITH {_LINES_SQL},
spans AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS line_no, text AS line FROM blocks),
evidence AS (
  SELECT s.doc_id, line_no, d.text, lower(replace(line, ' ', '  ')) AS span, 'own' AS origin FROM spans s JOIN documents d USING (doc_id)
  UNION ALL
  SELECT d.doc_id, line_no, d.text, line, 'next' FROM spans s JOIN documents d ON s.doc_id = d.doc_id + 1),
normal AS (SELECT doc_id, line_no, origin, {_NORM_SQL.format("text")} AS chunk, {_NORM_SQL.format("span")} AS said FROM evidence)
SELECT doc_id, line_no, origin FROM normal WHERE said <> '' AND contains(chunk, said)"""
)
def grounded_evidence(spark, sf_dir):
    """Every line, lower-cased and re-spaced against its own document, and as it is against the one before."""
    docs = _documents(spark, sf_dir)
    lines = F.filter(F.split("text", "\n"), lambda t: t.rlike(r"\S"))
    chunks = docs.select("doc_id", normal_span(F.col("text")).alias("chunk"))
    said = docs.select("doc_id", F.posexplode(lines).alias("pos", "line"))
    own = said.withColumn("span", F.lower(F.replace("line", F.lit(" "), F.lit("  ")))).withColumn("origin", F.lit("own"))
    following = said.withColumn("doc_id", F.col("doc_id") - 1).withColumn("span", F.col("line")).withColumn("origin", F.lit("next"))
    evidence = own.unionByName(following).join(chunks, "doc_id")
    grounded = evidence.where(span_grounded(F.col("chunk"), F.col("span")))
    return grounded.select("doc_id", (F.col("pos") + 1).alias("line_no"), "origin")


_TOKENS_SQL = "list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> ''))"


@query(
    rf"""WITH {_LINES_SQL},
spans AS (
  SELECT doc_id, n, {_NORM_SQL.format("text")} AS span,
         lead({_NORM_SQL.format("text")}) OVER (PARTITION BY doc_id ORDER BY n) AS other FROM blocks),
sets AS (
  SELECT *, {_TOKENS_SQL.format("span")} AS a, {_TOKENS_SQL.format("other")} AS b FROM spans
  WHERE other IS NOT NULL),
sizes AS (
  SELECT *, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS total FROM sets)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS pair_no,
  round(CASE WHEN total = 0 THEN 1.0 ELSE shared / total END, 6) AS jaccard,
  coalesce(shared * 5 >= total * 4 OR contains(span, other) OR contains(other, span), FALSE) AS overlaps
FROM sizes"""
)
def neighbour_overlap(spark, sf_dir):
    """Token-set similarity and overlap of each line with the next one."""
    lines = F.filter(F.split("text", "\n"), lambda t: t.rlike(r"\S"))
    rows = _documents(spark, sf_dir).select("doc_id", lines.alias("lines")).select(
        "doc_id", "lines", F.posexplode("lines").alias("pos", "a")
    )
    pairs = rows.select("doc_id", F.col("pos") + 1, normal_span(F.col("a")), normal_span(F.get("lines", F.col("pos") + 1)))
    pairs = pairs.toDF("doc_id", "pair_no", "a", "b").where(F.col("b").isNotNull())
    a, b = token_set(F.col("a")), token_set(F.col("b"))
    return pairs.select(
        "doc_id",
        "pair_no",
        F.round(jaccard(a, b), 6).alias("jaccard"),
        spans_overlap(F.col("a"), a, F.col("b"), b).alias("overlaps"),
    )


def _line_facts(spark: SparkSession, sf_dir: str, block: str) -> DataFrame:
    """Lines as facts: documents of one source are one document when ``block`` is ``source``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    lines = F.filter(F.split("text", "\n"), lambda t: t.rlike(r"\S"))
    rows = docs.select(
        F.col(block).cast("string").alias("doc_id"),
        F.col("doc_id").alias("_doc"),
        F.col("lang").alias("subject"),
        F.posexplode(lines).alias("pos", "evidence_span"),
    )
    return rows.select(
        "doc_id",
        (F.col("_doc") * 100_000 + F.col("pos")).alias("seq"),
        "subject",
        "evidence_span",
        ((F.length("evidence_span") % 10) / 10).alias("confidence"),
    )


_LEADERS_SQL = rf"""
facts AS (
  SELECT CAST(b.doc_id AS VARCHAR) AS doc_id, d.lang AS subject, {_NORM_SQL.format("b.text")} AS span,
         (length(b.text) % 10) / 10.0 AS confidence,
         b.doc_id * 100000 + row_number() OVER (PARTITION BY b.doc_id ORDER BY n) - 1 AS seq,
         row_number() OVER (PARTITION BY b.doc_id ORDER BY n) AS i
  FROM blocks b JOIN documents d USING (doc_id)),
sets AS (SELECT *, {_TOKENS_SQL.format("span")} AS toks FROM facts),
steps AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i,
         CAST([] AS STRUCT(seq BIGINT, span VARCHAR, toks VARCHAR[])[]) AS leaders,
         CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS leader
  FROM (SELECT DISTINCT doc_id FROM sets)
  UNION ALL
  SELECT doc_id, i, CASE WHEN hit IS NULL
           THEN list_append(leaders, {{'seq': seq, 'span': span, 'toks': toks}}) ELSE leaders END,
         seq, coalesce(hit, seq)
  FROM (SELECT s.doc_id, s.i, s.seq, s.span, s.toks, r.leaders,
          list_filter(r.leaders, lambda l: contains(l.span, s.span) OR contains(s.span, l.span)
            OR 5 * len(list_intersect(l.toks, s.toks))
               >= 4 * len(list_distinct(list_concat(l.toks, s.toks))))[1].seq AS hit
        FROM steps r JOIN sets s ON s.doc_id = r.doc_id AND s.i = r.i + 1)),
clusters AS (SELECT doc_id, seq, leader FROM steps WHERE i > 0)
"""


@query(f"WITH RECURSIVE {_LINES_SQL}, {_LEADERS_SQL} SELECT doc_id, seq, leader FROM clusters")
def near_duplicate_leaders(spark, sf_dir):
    return leader_clusters(_line_facts(spark, sf_dir, "doc_id")).select("doc_id", "seq", "leader")


@query(
    f"""WITH RECURSIVE {_LINES_SQL}, {_LEADERS_SQL}
SELECT doc_id, seq FROM (
  SELECT doc_id, seq, row_number() OVER (
    PARTITION BY doc_id, leader ORDER BY confidence DESC, seq) AS r
  FROM clusters JOIN sets USING (doc_id, seq)) WHERE r = 1"""
)
def near_duplicate_survivors(spark, sf_dir):
    return dedupe_facts(_line_facts(spark, sf_dir, "doc_id")).select("doc_id", "seq")


_SOURCE_LEADERS_SQL = rf"""
lines_of AS (
  SELECT d.source AS doc_id, lower(trim(d.lang)) AS subject_key, {_NORM_SQL.format("b.text")} AS span,
         b.doc_id * 100000 + row_number() OVER (PARTITION BY b.doc_id ORDER BY n) - 1 AS seq
  FROM blocks b JOIN documents d USING (doc_id)),
spans AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id, subject_key ORDER BY seq) AS i, {_TOKENS_SQL.format("span")} AS toks
  FROM (SELECT doc_id, subject_key, span, min(seq) AS seq FROM lines_of GROUP BY ALL)),
pairs_of AS MATERIALIZED (
  SELECT b.doc_id, b.subject_key, b.i, list(a.i ORDER BY a.i) AS before
  FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.subject_key = b.subject_key AND a.i < b.i
   AND (contains(a.span, b.span) OR contains(b.span, a.span)
     OR 5 * len(a.toks) >= 4 * len(b.toks) AND 5 * len(b.toks) >= 4 * len(a.toks)
        AND 9 * len(list_intersect(a.toks, b.toks)) >= 4 * (len(a.toks) + len(b.toks)))
  GROUP BY ALL),
steps AS (
  SELECT doc_id, subject_key, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders, CAST(NULL AS BIGINT) AS leader
  FROM (SELECT DISTINCT doc_id, subject_key FROM spans)
  UNION ALL
  SELECT doc_id, subject_key, i, CASE WHEN hit IS NULL THEN list_append(leaders, i) ELSE leaders END, coalesce(hit, i)
  FROM (SELECT s.doc_id, s.subject_key, s.i, r.leaders, list_min(list_intersect(o.before, r.leaders)) AS hit
        FROM steps r JOIN spans s ON s.doc_id = r.doc_id AND s.subject_key = r.subject_key AND s.i = r.i + 1
        LEFT JOIN pairs_of o ON o.doc_id = s.doc_id AND o.subject_key = s.subject_key AND o.i = s.i)),
led AS (SELECT doc_id, subject_key, i, leader FROM steps WHERE i > 0)
"""


@query(
    f"""WITH RECURSIVE {_LINES_SQL}, {_SOURCE_LEADERS_SQL}
SELECT l.doc_id, l.subject_key, l.seq, h.seq AS leader
FROM lines_of l JOIN spans s ON s.doc_id = l.doc_id AND s.subject_key = l.subject_key AND s.span = l.span
JOIN led ON led.doc_id = s.doc_id AND led.subject_key = s.subject_key AND led.i = s.i
JOIN spans h ON h.doc_id = s.doc_id AND h.subject_key = s.subject_key AND h.i = led.leader"""
)
def near_duplicate_leaders_by_source(spark, sf_dir):
    """Whole sources as documents: hot blocks, which take the distributed path."""
    return leader_clusters(_line_facts(spark, sf_dir, "source"), block_limit=256).select("doc_id", "subject_key", "seq", "leader")
