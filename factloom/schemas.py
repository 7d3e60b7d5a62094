"""Table schemas of the fact layer, as DDL strings."""

from __future__ import annotations

BLOCKS = (
    "doc_id string, page int, block_no int, text string, char_start long, char_end long, kind string"
)

CHUNKS = (
    "doc_id string, page int, chunk_no int, text string, char_start long, char_end long,"
    " section_hint string"
)

# The ten keys a claim row must carry (fixed values).
CLAIM_FIELDS = [
    "subject",
    "attribute",
    "value",
    "unit",
    "temporal_context",
    "scope_qualifiers",
    "evidence_span",
    "claim_text",
    "fact_kind",
    "confidence",
]

# Export column order (fixed values).
FACT_FIELDS = [
    "id",
    "doc_id",
    "subject",
    "attribute",
    "value",
    "unit",
    "temporal_context",
    "scope_qualifiers",
    "evidence_span",
    "page",
    "claim_text",
    "fact_kind",
    "confidence",
    "normalized_value",
    "normalized_unit",
    "period_start",
    "period_end",
    "canonical_subject",
]
EDGE_FIELDS = [
    "id",
    "fact_a_id",
    "fact_b_id",
    "relation",
    "reasoning",
    "reconciling_dimension",
    "confidence",
]

FACTS = (
    "id string, doc_id string, subject string, attribute string, value string, unit string,"
    " temporal_context string, scope_qualifiers array<string>, evidence_span string, page int,"
    " claim_text string, fact_kind string, confidence double, normalized_value double,"
    " normalized_unit string, period_start string, period_end string, canonical_subject string"
)
EDGES = (
    "id string, fact_a_id string, fact_b_id string, relation string, reasoning string,"
    " reconciling_dimension string, confidence double"
)
DOCUMENTS = (
    "id string, filename string, content_hash string, num_pages int, status string, created_at string"
)

# Relations and dimensions of an edge (fixed values).
RELATIONS = ["corroborate", "contradict", "reconcilable", "unrelated"]
DIMENSIONS = ["time", "scope", "unit", "none"]
