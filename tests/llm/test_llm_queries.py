import os

import pytest
from conftest import SMALL
from test_queries import compare

from lakeloom.llm import queries as Q

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
FOUND = {
    "p1_found": {"sec_id": "bigint", "prompt_version": "string"},
    "p2_found": {"row_idx_a": "bigint", "row_idx_b": "bigint"},
    "p5_found": {"sec_id": "bigint", "line_no": "int"},
    "p6_found": {"sec_id_a": "bigint", "sec_id_b": "bigint"},
    "p7_found": {"doc_id": "string", "section_index": "int", "line_no": "int", "lang": "string"},
    "p8_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p10_found": {"doc_id": "bigint", "category": "string"},
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    compare(spark, name, Q.QUERIES[name], Q.ORACLES.get(name))


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_and_distinct(spark, name):
    df = Q.QUERIES[name](spark, SMALL)
    assert dict(df.dtypes) == FOUND[name]
    assert df.count() == df.distinct().count()
