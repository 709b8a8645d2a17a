"""Every registered query of the package runs over the smallest tables with the stated columns."""

import pytest

from corpusloom.llm.queries import llm

COLUMNS = {"p2_found": ["tbl", "row_key", "line_no"], "p3_found": ["source", "session_id"], "p4_found": ["file_id"], "p5_found": ["chunk_id", "name"], "p6_found": ["tbl", "row_key", "lang"], "p7_found": ["qa_id_a", "qa_id_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(llm.queries))
def test_query(spark, small, name):
    rows = llm.queries[name](spark, small)
    got = rows.collect()
    if name in COLUMNS:
        assert rows.columns == COLUMNS[name] and got
        if name != "p8_ids":
            assert len(got) == len(set(got))


def test_sql(spark, small):
    from oracle import compare, connect

    con = connect(small)
    for name, sql in llm.sql.items():
        got, want, extra, missing = compare(spark, con, small, llm.queries[name], sql)
        assert not extra and not missing, (name, got, want, extra, missing)
