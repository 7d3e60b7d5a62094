"""All registered queries."""

from factloom.plans import layer_queries, rule_queries, text_queries, vector_queries  # noqa: F401
from factloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
