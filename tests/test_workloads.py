import __spark_entry__ as entry


def test_every_sql_belongs_to_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 140


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["image_name", "label", "plot"] and out.count() > 0
