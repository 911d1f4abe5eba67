import pytest

from leafmill.llm.queries import REGISTRY
from tests.compare import from_sql, rows

FOUND = {
    "p1_found": ["source_table", "record_key"],
    "p2_found": ["doc_id_a", "doc_id_b"],
    "p3_found": ["issue", "stage", "page"],
    "p4_found": ["source_table", "record_key", "field", "entity_id"],
    "p5_found": ["source_table", "record_key", "line_no", "defect"],
    "p6_found": ["doc_id"],
    "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_same_rows_as_sql(spark, sf, name):
    got, want = REGISTRY.queries[name](spark, sf).toPandas(), from_sql(REGISTRY.sql[name], sf)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_distinct_rows(spark, sf, name):
    got = REGISTRY.queries[name](spark, sf)
    assert got.columns == FOUND[name]
    n = got.count()
    assert n > 0 and got.distinct().count() == n


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_empty_tables(spark, empty_dir, name):
    assert REGISTRY.queries[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_nulls_empty_and_long_texts_repeated_rows_and_clashing_columns(spark, edge_dir, name):
    got = REGISTRY.queries[name](spark, edge_dir)
    n = got.count()
    if name in FOUND:
        assert got.distinct().count() == n
