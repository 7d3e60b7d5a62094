"""The keyed copy of the documents goes once a later stage reads a stored result, and not before."""

import os

import corpus_pipeline as pipeline
from factloom.session import materialize


def test_keyed_documents_are_deleted_once_a_stored_result_is_read(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3}", "en", "web", 6) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    first = pipeline.without_copies(spark, docs, "")
    keyed = next(reversed(pipeline._KEYED.values()))
    at = keyed.written_to
    # A result that is not stored still reads the table, cached or not.
    assert pipeline.without_copies(spark, first, "").count() == 3 and os.path.exists(at)
    cached = first.cache()
    assert pipeline.without_copies(spark, cached, "").count() == 3 and os.path.exists(at)
    cached.unpersist()
    stored = materialize(first, "stored")
    second = pipeline.without_copies(spark, stored, "")
    assert not os.path.exists(at)
    assert sorted(r.doc_id for r in second.collect()) == [0, 1, 2]
    assert pipeline.without_copies(spark, stored, "").count() == 3
