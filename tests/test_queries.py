import pytest

from eventlens.plans.queries import ORACLE_SQL, QUERIES

from .compare import same


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    if name in ORACLE_SQL:
        same(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
    else:
        QUERIES[name](spark, sf_dir).collect()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["span_start", "n", "total", "users"]
