"""All queries of the core and their SQL."""

from __future__ import annotations

from siftwork.plans import core_problems, document_queries, reference_queries, scalar_queries


def queries() -> dict:
    return {**core_problems.QUERIES, **reference_queries.QUERIES, **scalar_queries.QUERIES, **document_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**reference_queries.SQL, **scalar_queries.SQL, **document_queries.SQL}
