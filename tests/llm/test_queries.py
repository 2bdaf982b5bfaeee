"""The registered queries of the subpackage over the smallest tables: against their SQL, or for rows and columns."""

import pytest

from burstline.llm import oracle, queries

from ..compare import difference

COLUMNS = {
    "p1_found": ["id_a", "id_b"], "p2_found": ["term", "mark"], "p3_found": ["id_str", "term"], "p4_found": ["item_a", "item_b"], "p5_found": ["id_str", "lang"],
    "p7_found": ["id_a", "id_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_sql(spark, folder, name):
    assert difference(spark, queries.QUERIES[name], oracle.SQL[name], folder) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_runs(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert len(rows) == len({str(r) for r in rows})
