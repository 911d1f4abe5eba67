import pytest

from leafmill.plans.core import REGISTRY
from tests.compare import from_sql, rows


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_same_rows_as_sql(spark, sf, name):
    got, want = REGISTRY.queries[name](spark, sf).toPandas(), from_sql(REGISTRY.sql[name], sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_queries_without_sql_give_rows(spark, sf, name):
    assert REGISTRY.queries[name](spark, sf).limit(1).count() == (0 if name == "cer_other_lines" else 1)


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_empty_tables(spark, empty_dir, name):
    n = REGISTRY.queries[name](spark, empty_dir).count()
    assert n == (1 if name == "types_present" else 0)


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_nulls_empty_and_long_texts_repeated_rows_and_clashing_columns(spark, edge_dir, name):
    REGISTRY.queries[name](spark, edge_dir).write.format("noop").mode("overwrite").save()


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["issue", "head", "n"]
