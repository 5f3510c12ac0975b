"""All named queries and their DuckDB oracles."""

from __future__ import annotations

from . import (catalog_sql, context, oracle_catalog_sql, navigation, oracle_context, oracle_navigation, oracle_scoring, oracle_telemetry, oracle_vectors, oracle_workload, scoring, telemetry,
               vectors, workload)


def queries() -> dict:
    out = {}
    out.update(workload.QUERIES)
    out.update(telemetry.QUERIES)
    out.update(scoring.QUERIES)
    out.update(vectors.QUERIES)
    out.update(navigation.QUERIES)
    out.update(context.QUERIES)
    out.update(catalog_sql.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    out.update(oracle_workload.oracle())
    out.update(oracle_telemetry.oracle())
    out.update(oracle_scoring.oracle())
    out.update(oracle_vectors.oracle())
    out.update(oracle_navigation.oracle())
    out.update(oracle_context.oracle())
    out.update(oracle_catalog_sql.oracle())
    return out
