import __spark_entry__ as entry


def test_contract(spark):
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and all(callable(f) for f in found.values())
    assert entry.entry(spark).count() > 0
