"""Every registered query of the subpackage runs over the tables, with its stated columns."""

import pytest

from chatterloom.llm import catalog

COLUMNS = {
    "p1_found": "src rec_id kind", "p1_redacted": "src rec_id clean", "p2_found": "msg_id field", "p2_restored": "msg_id field original", "p3_found": "file reason",
    "p3_conversations": "file turn role sender text at", "p4_found": "field msg_a msg_b", "p4_canonical": "msg_id sender_form text_form", "p6_found": "name_a name_b",
    "p8_ids": "doc_id ids", "p9_pack": "limit_id container doc_id piece start n_tokens n_loss",
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    assert got.columns == COLUMNS.get(name, " ".join(got.columns)).split()
    rows = got.toPandas()
    assert len(rows)
    if name.endswith("_found"):
        assert not rows.duplicated().any() and not rows.isna().any().any()
    if name in ("p1_redacted", "p4_canonical"):
        assert len(rows) == sum(catalog.table(spark, sf, t).count() for t in ("messages", *(["pairs"] if name == "p1_redacted" else [])))
    if name == "p8_ids":
        assert len(rows) == catalog.table(spark, sf, "documents").count()
