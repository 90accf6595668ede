"""All core queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from loomspark.plans import billing, catalog, corpus, evaluation, judging, operations, records, requests, search  # noqa: F401
from loomspark.plans.catalog import Query

FLAGSHIP = "retrieval_metrics"


def queries() -> dict[str, Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
