import __spark_entry__ as e


def test_entry_smoke(spark):
    assert e.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())
