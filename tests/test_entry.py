import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["conv_id", "kind", "items"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
