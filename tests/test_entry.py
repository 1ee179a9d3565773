import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).columns
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 60
