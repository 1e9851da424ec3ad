import __spark_entry__ as e


def test_entry_runs(spark):
    assert e.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
