"""Queries on vectors: embeddings, exact and approximate neighbours, retrieval for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.functions.vectors import hash_embedding, text_embedding, token_embedding
from factloom.operators.layer import upsert_by_id
from factloom.operators.nearest import collection_size, lsh_join, nearest_join, nearest_to
from factloom.operators.qa import answer, contexts, retrieve
from factloom.plans.claims import once, table
from factloom.plans.registry import query
from factloom.session import materialize, spread


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


_COSINE = """abs(round(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9))"""


def _neighbours(condition: str, tie: str = "b_id") -> str:
    return f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (SELECT a.vec_id AS query_id, b.vec_id AS b_id, {_COSINE} AS d FROM v a JOIN v b ON {condition})
SELECT query_id, b_id AS base_id, round(d, 6) AS distance, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, {tie}) AS INT) AS rank FROM scored)
WHERE rank <= 5"""


def _result(found: DataFrame) -> DataFrame:
    return found.select("query_id", "base_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
v AS (SELECT doc_id, list_transform(range(16),
  lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) / 255.0::DOUBLE * 2.0 - 1.0) AS e FROM h)
SELECT doc_id, unnest(range(16)) AS place, round(unnest(e) / sqrt(list_dot_product(e, e)), 6) AS value FROM v"""
)
def hash_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", hash_embedding(F.col("text")).alias("e"))
    places = docs.select("doc_id", F.posexplode("e").alias("place", "value"))
    return places.select("doc_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query()
def weighted_word_vectors(spark, sf_dir):
    """TF-IDF vectors of the documents: filled places and length of each."""
    docs = text_embedding(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return docs.select(
        "doc_id",
        F.size(F.filter("embedding", lambda x: x != 0)).alias("filled"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"),
    )


@query(_neighbours("TRUE"))
def nearest_vectors(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return _result(nearest_join(rows, rows, 5, query_id="vec_id", base_id="vec_id"))


@query(_neighbours("a.label <> b.label"))
def nearest_of_other_label(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return _result(nearest_join(rows, rows, 5, query_id="vec_id", base_id="vec_id", differ="label"))


@query(_neighbours("a.label = b.label"))
def nearest_of_same_label(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return _result(nearest_join(rows, rows, 5, query_id="vec_id", base_id="vec_id", match=["label"]))


@query(_neighbours("a.label <> b.label AND b.vec_id < a.vec_id"))
def nearest_earlier_of_other_label(spark, sf_dir):
    """As when relating facts: other documents (labels), ingested earlier (smaller ids)."""
    rows = _vectors(spark, sf_dir).withColumn("seq", F.col("vec_id"))
    found = nearest_join(rows, rows, 5, query_id="vec_id", base_id="vec_id", differ="label", earlier="seq")
    return _result(found)


@query(_neighbours("TRUE"))
def nearest_vectors_by_regions(spark, sf_dir):
    """The same exact result through pivot regions and the two pruned passes."""
    rows = _vectors(spark, sf_dir)
    return _result(nearest_join(rows, rows, 5, query_id="vec_id", base_id="vec_id", cells=8, rows_per_task=512))


@query(
    f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT b.vec_id, round({_COSINE}, 6) AS distance FROM v a JOIN v b ON a.vec_id = 0 AND b.label <> 3
ORDER BY {_COSINE}, b.vec_id LIMIT 10"""
)
def nearest_to_one_vector(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>"))
    wanted = rows.where("vec_id = 0").first().embedding
    found = nearest_to(wanted, rows, 10, base_id="vec_id", where={"label": {"$ne": 3}})
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query()
def approximate_neighbours(spark, sf_dir):
    """Search of the three nearest regions, with the share of exact neighbours found per query."""
    rows = _vectors(spark, sf_dir)
    ids = {"query_id": "vec_id", "base_id": "vec_id"}
    exact = nearest_join(rows, rows, 5, **ids).select("query_id", "base_id")
    near = nearest_join(rows, rows, 5, cells=16, probes=3, **ids).select("query_id", "base_id", F.lit(1).alias("hit"))
    both = exact.join(near, ["query_id", "base_id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


@query(
    """SELECT method, count(*) * 5 AS neighbours, TRUE AS reached FROM embeddings, (VALUES ('lsh'), ('regions')) m(method) GROUP BY method"""
)
def approximate_recall(spark, sf_dir):
    """Whether each approximate search finds at least nine tenths of the exact neighbours of all vectors."""
    rows = _vectors(spark, sf_dir)
    ids = {"query_id": "vec_id", "base_id": "vec_id"}
    exact = materialize(nearest_join(rows, rows, 5, **ids).select("query_id", "base_id"), "exact")
    found = lsh_join(rows, rows, 5, **ids).withColumn("method", F.lit("lsh"))
    found = found.unionByName(nearest_join(rows, rows, 5, cells=16, probes=13, **ids).withColumn("method", F.lit("regions")))
    hits = exact.join(found.select("method", "query_id", "base_id"), ["query_id", "base_id"]).groupBy("method").agg(F.count("*").alias("hits"))
    total = exact.agg(F.count("*").alias("neighbours"))
    return hits.join(total, F.lit(True)).select("method", "neighbours", (F.col("hits") >= 0.9 * F.col("neighbours")).alias("reached"))


@query("SELECT vec_id AS id, CASE WHEN label >= 5 THEN label + 100 ELSE label END AS label, unnest(range(len(embedding))) AS place, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def upserted_vectors(spark, sf_dir):
    """Vectors of the upper labels are sent again under other labels."""
    rows = _vectors(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>"))
    stored = rows.withColumnRenamed("vec_id", "id").withColumn("version", F.lit(1))
    again = stored.where("label >= 5").withColumns({"label": F.col("label") + 100, "version": F.lit(2)})
    rows = upsert_by_id(stored, again)
    places = rows.select("id", "label", F.posexplode("embedding").alias("place", "value"))
    return places.select("id", "label", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query("SELECT count(*) AS size FROM embeddings")
def vector_count(spark, sf_dir):
    return collection_size(_vectors(spark, sf_dir))


_TOKEN_VECTOR = """list_transform(range(64), lambda d: CAST(len(list_filter(slots, lambda s: s = d)) AS DOUBLE))"""
_SLOTS = r"""list_transform(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '),
  lambda t: t <> ''), lambda t: CAST('0x' || substr(sha256(t), 1, 4) AS INT) % 64)"""

_RETRIEVED = f"""
passages AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n,
         unnest(string_split(text, chr(10))) AS text FROM documents),
facts AS (
  SELECT 'p' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '-' || lpad(CAST(n AS VARCHAR), 6, '0') AS id, doc_id, text,
         {_SLOTS} AS slots FROM passages WHERE regexp_matches(text, '\\S')),
fv AS (SELECT *, {_TOKEN_VECTOR} AS e FROM facts),
questions AS (SELECT item_id AS question_id, text, {_SLOTS} AS slots FROM benchmark),
qv AS (SELECT *, {_TOKEN_VECTOR} AS e FROM questions),
scored AS (
  SELECT question_id, b.id, abs(round(CASE WHEN list_sum(a.e) = 0 OR list_sum(b.e) = 0 THEN 1 ELSE
      1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) END, 9)) AS d
  FROM qv a CROSS JOIN fv b),
ranked AS (
  SELECT question_id, id, d, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, id) AS rank FROM scored) WHERE rank <= 8)
""".replace("\\\\", "\\")


def _passages(spark, sf_dir) -> DataFrame:
    """Document lines as facts to answer from."""

    def build():
        lines = spread(table(spark, sf_dir, "documents")).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        number = lambda c, n: F.lpad(c.cast("string"), n, "0")
        key = F.concat(F.lit("p"), number(F.col("doc_id"), 9), F.lit("-"), number(F.col("pos") + 1, 6))
        facts = lines.where(F.col("text").rlike(r"\S")).select(
            key.alias("id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"),
            F.col("source").alias("subject"), F.lit("passage").alias("attribute"),
            F.length("text").cast("string").alias("value"), F.lit("chars").alias("unit"),
            F.lit("").alias("temporal_context"), F.col("text").alias("evidence_span"),
            F.col("text").alias("claim_text"), token_embedding(F.col("text")).alias("embedding"),
        )
        return materialize(facts, "passages")

    return once(spark, ("passages", sf_dir), build)


def _questions(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"),
        token_embedding(F.col("text")).alias("embedding"),
    )


@query(f"WITH {_RETRIEVED} SELECT question_id, id AS fact_id, rank, round(d, 6) AS distance FROM ranked")
def retrieved_facts(spark, sf_dir):
    found = retrieve(_questions(spark, sf_dir), _passages(spark, sf_dir))
    return found.select("question_id", F.col("fact.id").alias("fact_id"), "rank", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {_RETRIEVED}, lines AS (
  SELECT question_id, rank, '[' || f.id || '] ' || source || ' / passage = ' || length(f.text) || ' chars /  / "' || f.text || '"' AS line
  FROM ranked JOIN facts f USING (id) JOIN documents d ON d.doc_id = f.doc_id)
SELECT question_id, string_agg(line, chr(10) ORDER BY rank) AS context FROM lines GROUP BY question_id"""
)
def question_contexts(spark, sf_dir):
    found = retrieve(_questions(spark, sf_dir), _passages(spark, sf_dir))
    return contexts(found)


@query(f"WITH {_RETRIEVED} SELECT question_id, q.text AS question, f.text AS answer FROM ranked JOIN facts f USING (id) JOIN questions q USING (question_id) WHERE rank = 1")
def grounded_answers(spark, sf_dir):
    answers, _ = answer(_questions(spark, sf_dir), _passages(spark, sf_dir))
    return answers


@query(
    f"""WITH {_RETRIEVED} SELECT question_id, id AS fact_id, CAST(doc_id AS VARCHAR) AS doc_id, f.text AS evidence_span,
  CASE rank WHEN 2 THEN 0 ELSE 2 END AS position FROM ranked JOIN facts f USING (id) WHERE rank IN (1, 2)"""
)
def model_citations(spark, sf_dir):
    """A caller's model cites its second fact, an unknown id and its first fact."""
    import json

    def complete(_system: str, user: str) -> str:
        ids = [line[1 : line.index("]")] for line in user.split("Facts:\n", 1)[1].split("\n")]
        cited = [ids[1], "unknown", ids[0]]
        return "Here it is: " + json.dumps({"answer": "see facts", "cited_fact_ids": cited})

    _, cited = answer(_questions(spark, sf_dir), _passages(spark, sf_dir), complete)
    return cited.select("question_id", "fact_id", "doc_id", "evidence_span", "position")

