"""Stored pages of one url are one file to dynamic_findings, as in its SQL: numbered together, and equal findings once."""

import duckdb
import pytest

from websource_audit.operators import findings as D
from websource_audit.plans import queries as Q
from websource_audit.sources.corpus import K

ONE, TWO = "https://h.example/a/one", "https://h.example/a/two"
CALL = "<b onclick=\"$.get('/b')\">b</b>"


@pytest.mark.parametrize("shared", [True, False])
def test_pages_of_one_url(spark, tmp_path, shared):
    pages = [(6, ""), (K + 6, ""), (7, "<p>"), (11, "<!-- <p> --><!--\n-->" + CALL), (K + 7, "<p><p><p>" + CALL + CALL), (8, "<p></p>" * 9 + "\n" + CALL), (2, "<i></i><i></i>")]
    rows = [(i, ONE if shared else f"{ONE}/{i}", html) for i, html in pages] + [(21, TWO, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Q.QUERIES["dynamic_findings"](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        want = db.execute(f"select {', '.join(got.columns)} from ({Q.ORACLE_SQL['dynamic_findings']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert len(want) == (8 if shared else 11)


def test_page_without_url(spark):
    rows = [(1, None, "<script>fetch('/a')</script>"), (2, TWO, None)]
    assert D.dynamic_findings(spark.createDataFrame(rows, "page_id long, url string, content string")).collect() == []


def test_equal_places_go_by_page(spark):
    pages = [(n, ONE, f"<script>fetch('/{n}')</script><style></style>") for n in range(5, 0, -1)]
    rows = D.dynamic_findings(spark.createDataFrame(pages, "page_id long, url string, content string").repartition(3)).collect()
    assert sorted((r.finding_no, r.endpoint_url) for r in rows) == [(n - 1, f"/{n}") for n in range(1, 6)]
    assert "kind" not in rows[0]
