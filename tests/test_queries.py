"""Every registered query against its SQL, on the smallest tables."""

import pytest
from helpers import connect, same

from reelmark import registry


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, small, con, name):
    same(registry.QUERIES[name](spark, small), con, registry.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())


def test_scores_read_the_documents_once(spark, small):
    from reelmark.plans import exchange

    plan = exchange.trace_audit_scores(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert " json" not in plan and " parquet" in plan


def test_an_audit_reads_each_trace_once(spark, small):
    """The confidence traces are read when the audit is made; the plan reads the others' folders, each of them once."""
    from reelmark.plans import exchange

    plan = exchange.trace_audit(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" json") == 2
