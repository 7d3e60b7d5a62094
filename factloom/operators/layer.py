"""Queries and upserts on the stored layer: documents, facts, edges, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FACT_PAGE = 200


def _digest(rows: DataFrame) -> Column:
    """Hash of the content of a row; nulls and signs of zeros count."""
    fields = rows.schema.fields
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)

    def written(field: T.StructField) -> Column:
        value = F.col(field.name)
        if isinstance(field.dataType, nested):
            return F.to_json(F.struct(value))
        return value.cast("string") if isinstance(field.dataType, T.FractionalType) else value

    return F.xxhash64(*[written(f) for f in fields], *[F.col(f.name).isNull() for f in fields if f.nullable])


def latest_by(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str = "version") -> DataFrame:
    """Union in which a row stays only if it is the latest for *each* of the unique ``keys``.

    Later rows replace earlier ones that share any key: by ``order``, then incoming before stored, then by
    a hash of the content, so that one row stays of equal versions and a replay changes nothing. The latest
    per key is a combinable maximum, so a key held by a third of the rows is no bottleneck.
    """
    columns = stored.columns
    rows = stored.withColumn("_sent", F.lit(0)).unionByName(incoming.select(*columns).withColumn("_sent", F.lit(1)))
    digest = _digest(rows.select(*columns))
    rows = rows.select(*columns, F.struct(F.col(order).alias("order"), "_sent", digest.alias("digest")).alias("_turn"))
    if len(keys) == 1:
        # The key stands for itself and is not shuffled a second time within the row.
        rest = [c for c in columns if c != keys[0]]
        last = rows.groupBy(keys[0]).agg(F.max_by(F.struct(*rest), "_turn").alias("_row"))
        return last.select(*[F.col(c) if c == keys[0] else F.col("_row")[c].alias(c) for c in columns])
    kept = rows.distinct()
    for key in keys:
        last = rows.groupBy(key).agg(F.max("_turn").alias("_last"))
        kept = kept.join(last, key).where(F.col("_turn") == F.col("_last")).drop("_last")
    return kept.select(*columns)


def upsert_documents(stored: DataFrame, incoming: DataFrame, order: str = "version") -> DataFrame:
    """Documents are unique by id and by content hash."""
    return latest_by(stored, incoming, ["id", "content_hash"], order)


def upsert_by_id(stored: DataFrame, incoming: DataFrame, order: str = "version") -> DataFrame:
    """Facts, edges and vectors are unique by id; a resent row replaces the stored one."""
    return latest_by(stored, incoming, ["id"], order)


def documents_with_hash(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """Stored documents whose content is among ``hashes`` (exact duplicates)."""
    return documents.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")


def document_list(documents: DataFrame) -> DataFrame:
    return documents.orderBy("created_at", "id")


def filter_facts(
    facts: DataFrame,
    min_confidence: float = 0.0,
    doc_id: str | None = None,
    subject: str | None = None,
    fact_kind: str | None = None,
) -> DataFrame:
    rows = facts.where(F.col("confidence") >= min_confidence)
    for column, value in (("doc_id", doc_id), ("subject", subject), ("fact_kind", fact_kind)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def fact_page(facts: DataFrame, limit: int = FACT_PAGE, offset: int = 0, order: tuple = ("id",)) -> DataFrame:
    return facts.orderBy(*order).offset(offset).limit(limit)


def by_id(rows: DataFrame, row_id: str, column: str = "id") -> DataFrame:
    return rows.where(F.col(column) == row_id)


def by_ids(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Bulk lookup: each wanted id once, unknown ids dropped."""
    return rows.join(ids.select(column).distinct(), column)


def facts_per_document(facts: DataFrame) -> DataFrame:
    return facts.groupBy("doc_id").agg(F.count("*").alias("n_facts"))


def documents_with_counts(documents: DataFrame, facts: DataFrame) -> DataFrame:
    counts = facts_per_document(facts).withColumnRenamed("doc_id", "id")
    return documents.join(counts, "id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))


def edges_by_relation(edges: DataFrame, relation: str | None = None) -> DataFrame:
    return edges if relation is None else edges.where(F.col("relation") == relation)


def edges_of_document(edges: DataFrame, facts: DataFrame, doc_id: str) -> DataFrame:
    """Edges with an endpoint in the document; edges with a missing endpoint are dropped.

    The document's facts are picked first, so that only its edges meet the other facts.
    """
    own = facts.where(F.col("doc_id") == doc_id).select("id")
    touching = None
    for side, other in (("a", "b"), ("b", "a")):
        found = edges.join(own.withColumnRenamed("id", f"fact_{side}_id"), f"fact_{side}_id", "left_semi")
        found = found.join(facts.select(F.col("id").alias(f"fact_{other}_id")), f"fact_{other}_id", "left_semi").select(*edges.columns)
        touching = found if touching is None else touching.unionByName(found)
    return touching.distinct()


def enriched_edges(edges: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with both facts as structs, null where a fact is missing."""
    from factloom.operators.relate import with_facts

    return with_facts(edges, facts, columns, how="left").select(*edges.columns, "a", "b")


def layer_totals(documents: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: documents, facts, edges."""
    counts = None
    for name, rows in (("documents", documents), ("facts", facts), ("edges", edges)):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = one if counts is None else counts.unionByName(one)
    pick = lambda name: F.sum(F.when(F.col("table") == name, F.col("n"))).alias(name)
    return counts.agg(pick("documents"), pick("facts"), pick("edges"))


def confidence_band(confidence: Column) -> Column:
    value = F.coalesce(confidence, F.lit(0.0))
    return F.when(value >= 0.8, "high").when(value >= 0.5, "mid").otherwise("low")


def confidence_percent(confidence: Column) -> Column:
    return F.round(F.coalesce(confidence, F.lit(0.0)) * 100).cast("int")


def period_label(temporal_context: Column, period_start: Column) -> Column:
    """What the source says, else year and month of the start, else a dash."""
    said = F.nullif(temporal_context, F.lit(""))
    return F.coalesce(said, F.nullif(F.substring(period_start, 1, 7), F.lit("")), F.lit("-"))


def attribute_vocabulary(facts: DataFrame) -> DataFrame:
    counts = facts.groupBy("attribute").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "attribute")


def add_to_vocabulary(vocabulary: DataFrame, facts: DataFrame) -> DataFrame:
    """Stored counts plus those of new facts."""
    new = facts.groupBy("attribute").agg(F.count("*").alias("n"))
    both = vocabulary.select("attribute", "n").unionByName(new)
    return both.groupBy("attribute").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "attribute")
