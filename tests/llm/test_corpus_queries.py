"""Queries of the corpus problems against SQL, and their schemas."""

from __future__ import annotations

import pytest

from compare import database, same_rows
from skein.llm import queries

FOUND = {
    "p1_found": "group_id bigint, id bigint",
    "p2_found": "comment_id bigint, field_name string, kind string",
    "p3_found": "comment_id bigint, lang string",
    "p4_found": "tbl string, kept_id bigint, copy_id bigint",
    "p5_found": "comment_id bigint",
    "p6_found": "tbl string, row_id bigint",
    "p7_found": "comment_id_a bigint, comment_id_b bigint",
    "p8_ids": "doc_id bigint, ids array<int>",
    "p10_found": "doc_id bigint, subject string",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    same_rows(queries.queries()[name](spark, sf), database(sf), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    if name in FOUND:
        assert ", ".join(f"{a} {b}" for a, b in df.dtypes) == FOUND[name]
    assert df.count() == df.distinct().count()
