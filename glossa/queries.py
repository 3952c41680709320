"""Queries of the engine on the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_io, queries_literature, queries_plan, queries_rows, queries_runs, queries_sources, queries_streams, queries_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**queries_literature.QUERIES, **queries_rows.QUERIES, **queries_runs.QUERIES, **queries_sources.QUERIES, **queries_streams.QUERIES, **queries_io.QUERIES, **queries_plan.QUERIES, **queries_views.QUERIES}
ORACLE_SQL: dict[str, str] = {**queries_literature.ORACLE_SQL, **queries_rows.ORACLE_SQL, **queries_runs.ORACLE_SQL, **queries_sources.ORACLE_SQL, **queries_streams.ORACLE_SQL, **queries_io.ORACLE_SQL, **queries_plan.ORACLE_SQL, **queries_views.ORACLE_SQL}
