"""SQL that rebuilds the claim corpus, its facts, candidates and edges from the star schema."""

from __future__ import annotations


DIM = 64


def whole(tables: str, rows: str) -> str:
    """A statement whose rows are computed before the first one is returned."""
    return f"WITH {tables}, result AS MATERIALIZED ({rows}) SELECT * FROM result"


# Amounts are whole cents, so that the digits of each statement come from integer arithmetic.
FACTS = r"""
totals AS (
  SELECT o_custkey AS k, year(o_orderdate) AS y,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) * 100 AS BIGINT) AS c
  FROM orders GROUP BY ALL),
fiscal AS (
  SELECT o_custkey AS k, year(o_orderdate) + CAST(month(o_orderdate) >= 4 AS INT) AS y,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) * 100 AS BIGINT) AS c
  FROM orders GROUP BY ALL),
net AS (
  SELECT o_custkey AS k, year(o_orderdate) AS y,
         CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
              AS DECIMAL(18,2)) * 100 AS BIGINT) AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
stated AS MATERIALIZED (
  SELECT 1 AS ledger, k, 'CY' AS p, y, c, c // 100000 || '.' || lpad(CAST(c % 100000 AS VARCHAR), 5, '0') AS value,
         'thousand USD' AS unit, '' AS hedge, '' AS scope FROM totals
  UNION ALL
  SELECT 2, k, 'CY', y, c, c // 10000000 || '.' || lpad(CAST(c % 10000000 AS VARCHAR), 7, '0'),
         'lakh USD', '', '' FROM totals
  UNION ALL
  SELECT 3, k, 'CY', y, c, format('{:,}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0'),
         'USD', 'about ', '' FROM net
  UNION ALL
  SELECT 4, k, 'FY', y, c, c // 100000 || '.' || lpad(CAST(c % 100000 AS VARCHAR), 5, '0'),
         'thousand USD', '', '' FROM fiscal
  UNION ALL
  SELECT 5, k, 'CY', y, c, format('{:,}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0'),
         'USD', '', 'net' FROM net),
claims AS MATERIALIZED (
  SELECT ledger, k, c_name AS subject, 'revenue' AS attribute, value, unit, p || y AS temporal_context, scope,
         c_name || ' revenue was ' || hedge || value || ' ' || unit || ' in ' || p || y
           || CASE WHEN scope = '' THEN '' ELSE ' (' || scope || ')' END || '.' AS claim_text,
         'numerical' AS fact_kind, CASE WHEN hedge = '' THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence,
         c / 100.0::DOUBLE AS normalized_value, 'USD' AS normalized_unit,
         CASE p WHEN 'CY' THEN y || '-01-01' ELSE (y - 1) || '-04-01' END AS period_start,
         CASE p WHEN 'CY' THEN y || '-12-31' ELSE y || '-03-31' END AS period_end,
         row_number() OVER (PARTITION BY ledger, k ORDER BY p || y) - 1 AS seq
  FROM stated JOIN customer ON c_custkey = k
  UNION ALL
  SELECT ledger, k, c_name, 'segment', c_mktsegment, '', '', '',
         c_name || ' segment was ' || c_mktsegment || '.', 'semantic', 0.75, NULL, NULL, NULL, NULL,
         (SELECT count(*) FROM totals t WHERE t.k = d.k)
  FROM (SELECT DISTINCT ledger, k FROM stated WHERE ledger <= 2) d JOIN customer ON c_custkey = k),
facts AS MATERIALIZED (
  SELECT 'fact_' || substr(sha256('L' || ledger || '-' || k || chr(0) || '1' || chr(0) || '0' || chr(0) || seq), 1, 32) AS id,
         'L' || ledger || '-' || k AS doc_id, subject, attribute, value, unit, temporal_context,
         scope AS scope_qualifiers, claim_text AS evidence_span, 1 AS page, claim_text, fact_kind, confidence,
         normalized_value, normalized_unit, period_start, period_end,
         regexp_replace(lower(subject), '#', '') AS canonical_subject, seq, CAST(ledger AS BIGINT) AS ingest_seq
  FROM claims)
"""


_VECTORS = f"""
slotted AS (
  SELECT *, list_transform(list_filter(
      string_split(regexp_replace(lower(claim_text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '),
      lambda t: t <> ''), lambda t: CAST('0x' || substr(sha256(t), 1, 4) AS INT) % {DIM}) AS slots
  FROM facts),
vectors AS MATERIALIZED (
  SELECT *, list_transform(range({DIM}),
      lambda d: CAST(len(list_filter(slots, lambda s: s = d)) AS DOUBLE)) AS v FROM slotted)
"""

CANDIDATES = f"""{FACTS}, {_VECTORS},
scored AS (
  SELECT a.id AS fact_a_id, b.id AS fact_b_id, b.ingest_seq AS b_seq,
         abs(round(1 - list_dot_product(a.v, b.v)
           / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9)) AS distance
  FROM vectors a JOIN vectors b
    ON a.canonical_subject = b.canonical_subject AND a.attribute = b.attribute
   AND a.doc_id <> b.doc_id AND b.ingest_seq < a.ingest_seq),
pairs AS MATERIALIZED (
  SELECT fact_a_id, fact_b_id, distance, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY fact_a_id ORDER BY distance, b_seq, fact_b_id) AS INT) AS rank
    FROM scored) WHERE rank <= 8)
"""

_RELATION = """
CASE WHEN a.period_start <> b.period_start OR a.period_end <> b.period_end THEN 'reconcilable/time/periods differ'
     WHEN a.normalized_value IS NOT NULL AND abs(a.normalized_value - b.normalized_value)
          <= 0.005 * greatest(abs(a.normalized_value), abs(b.normalized_value)) THEN 'corroborate/none/values agree'
     WHEN a.scope_qualifiers <> b.scope_qualifiers THEN 'reconcilable/scope/scopes differ'
     WHEN a.normalized_value IS NOT NULL THEN 'contradict/none/values differ'
     WHEN lower(a.value) = lower(b.value) THEN 'corroborate/none/values agree'
     ELSE 'contradict/none/values differ' END
"""

EDGES = f"""{CANDIDATES},
judged AS (
  SELECT fact_a_id, fact_b_id, string_split({_RELATION}, '/') AS v, least(a.confidence, b.confidence) AS confidence
  FROM pairs JOIN facts a ON a.id = fact_a_id JOIN facts b ON b.id = fact_b_id),
edges AS (
  SELECT 'edge_' || substr(sha256(fact_a_id || chr(0) || fact_b_id), 1, 32) AS id, fact_a_id, fact_b_id,
         v[1] AS relation, v[3] AS reasoning, v[2] AS reconciling_dimension, confidence
  FROM judged)
"""

DOCUMENTS = f"""{FACTS},
layer_docs AS (
  SELECT doc_id AS id, doc_id || '.txt' AS filename,
         sha256('Ledger ' || any_value(ingest_seq) || ' of ' || any_value(subject) || chr(10)
                || string_agg(claim_text, chr(10) ORDER BY seq)) AS content_hash,
         1 AS num_pages, 'done' AS status, '2024-01-0' || any_value(ingest_seq) || 'T00:00:00' AS created_at
  FROM facts GROUP BY doc_id)
"""
