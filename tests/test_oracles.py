import pytest

from brindle.plans import catalogue

from .compare import duck_rows, spark_rows

ALL = catalogue.ALL


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ALL.items() if sql))
def test_equals_sql(spark, data, name):
    query, sql = ALL[name]
    assert spark_rows(query(spark, data)) == duck_rows(sql, data)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ALL.items() if not sql))
def test_runs(spark, data, name):
    first = spark_rows(ALL[name][0](spark, data))
    assert first[1] and first == spark_rows(ALL[name][0](spark, data))


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 40 and all(r.context.count("\n\n") >= 2 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
