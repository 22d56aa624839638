"""The driver contract: names agree, and each query's SQL names a query."""

import __spark_entry__ as e


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    df = e.entry(spark)
    assert df.columns == ["colors", "n_kmers"] and df.limit(1).count() == 1
