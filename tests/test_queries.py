"""Every registered query with SQL gives the same rows as that SQL."""

import pytest

from ledgerwatch.plans.oracles import ORACLES
from ledgerwatch.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, against_sql):
    against_sql(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["id", "account_id", "n_hits", "risk_score", "band"] and out.count() == 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
