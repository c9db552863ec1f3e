"""Every driver query of the posting operators against its oracle; those without one must give rows."""

import pytest
from compare import SF, check, connect

from tallyboard.plans import function_queries, stream_queries  # noqa: F401
from tallyboard.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, con, name):
    check(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["job_id", "title", "company", "posted_date"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
