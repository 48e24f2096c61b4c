"""Every query of the core that SQL can say, against SQL; the others must run."""

import pytest
from compare import spark_rows, sql_rows

from scoreloom.plans import data_queries, model_queries, quality, workflow_queries

QUERIES = {**data_queries.QUERIES, **model_queries.QUERIES, **quality.QUERIES, **workflow_queries.QUERIES}
ORACLES = {**data_queries.ORACLES, **model_queries.ORACLES, **quality.ORACLES, **workflow_queries.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, data, name):
    assert spark_rows(QUERIES[name](spark, data)) == sql_rows(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"logistic_text_fusion", "gbt_tabular", "stacked_text_score"}))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
