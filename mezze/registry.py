"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mezze.plans import menu_queries, page_queries, pipeline_queries, scalar_queries, stream_queries, venue_queries
from mezze.session import shipped

_ALL = venue_queries.QUERIES | scalar_queries.QUERIES | menu_queries.QUERIES | page_queries.QUERIES | pipeline_queries.QUERIES | stream_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipped(query) for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
