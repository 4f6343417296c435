"""Every registered query against its SQL, on the smallest tables."""

import pytest

from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES

UNCHECKED = {
    "sweep_full", "sweep_rounds", "train_logistic", "train_forest", "train_boosted", "train_rff_svc", "grid_search",
}


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


def test_every_query_has_sql_or_trains_models():
    assert set(QUERIES) - set(ORACLE) == UNCHECKED
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, db, small, name):
    ours = QUERIES[name](spark, small)
    theirs = db.execute(ORACLE[name]).fetch_df()
    assert difference(ours.toPandas(), theirs) == ""


def test_entry_runs(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() == 6
    assert set(oracle_sql()) <= set(queries())
