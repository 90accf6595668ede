"""The catalogue that query modules write into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: SQL of tables without redeliveries.
ITEMS = "(SELECT * FROM golden_items QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1)"
SECTIONS = "(SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY loaded_at DESC) = 1)"
ANSWERS = "(SELECT * FROM generation_rows QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC) = 1)"
HITS = "(SELECT * FROM hits WHERE score IS NOT NULL AND NOT isnan(score) QUALIFY row_number() OVER (PARTITION BY question_id, config_id, content_id ORDER BY loaded_at DESC) = 1)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the SQL that must give the same rows where there is one."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put
