import __spark_entry__


def test_every_query_is_registered_once_with_its_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 40


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id"] and df.count() == 108
