"""The queries of the audit operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import exchange, table_sql, tables

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]

QUERIES = {**tables.QUERIES, **exchange.QUERIES}
ORACLE_SQL = {**table_sql.ORACLE_SQL, **exchange.ORACLE_SQL}


def entry(spark: SparkSession) -> DataFrame:
    """Fused verdicts of the smallest tables' episodes."""
    return tables.final_verdict(spark, "/root/testdata/sf0.001")
