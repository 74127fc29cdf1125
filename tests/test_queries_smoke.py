"""The driver contract: entry, every registered query runs on sf0.001, oracle keys exist."""

import pytest

import __spark_entry__ as entry
from logweave.plans.queries import QUERIES
from tests.conftest import SF_SMALL



def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"category", "severity", "n_findings"}


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    df.count()
