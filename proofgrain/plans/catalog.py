"""All registered queries and their SQL."""

from __future__ import annotations

from proofgrain.plans import compare_queries, decision_queries, evidence_queries, quality_queries, retrieve_queries, source_queries, text_queries

_MODULES = (source_queries, text_queries, retrieve_queries, evidence_queries, decision_queries, compare_queries, quality_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
