"""Every query of the subpackage on the smallest tables, and the columns that TESTDATA.md gives the found ones."""

import os

import pytest

from quipwright.llm import queries

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["id"], "p2_found": ["record_id"], "p3_found": ["record_id", "language"], "p4_found": ["record_id"], "p5_found": ["item", "reaction"],
    "p7_found": ["record_a", "record_b"], "p10_found": ["doc_id"],
}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows)) and all(None not in r for r in rows)
