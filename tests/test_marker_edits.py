import os

import pytest

import __spark_entry__ as entry
from quipwright.session import table

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_texts_are_whole(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, DIR, "documents").select("doc_id", "text").collect()}
    rows = entry.queries()["marker_edits"](spark, DIR).collect()
    assert any(len(r["restored"]) > 60 for r in rows)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["restored"] == text and r["edited"] == "Umbrella" + text[len(r["original"]):]
