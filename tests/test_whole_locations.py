"""Registered queries that name the files of a snippet name all of them, as their SQL does, also beyond a page of the index."""

import duckdb
import pytest

from websource_audit.operators import correlate as C
from websource_audit.plans import queries as Q
from websource_audit.sources.corpus import K

FILES = C.PAGE_LOCATIONS * 2 + 5


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """A table of pages: FILES with a script that has a call, FILES with one that has none and so no crawled row, and a few others."""
    ids = [K * k + turn for turn in (6, 3) for k in range(FILES)] + list(range(K))
    rows = [(i, f"https://h{i % 3}.example/s{i % 5}/p{i}", "<p>x</p>") for i in dict.fromkeys(ids)]
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize(("name", "files"), [("correlate", "locations"), ("missing_in_crawl", "locations"), ("correlation_matrix", "static_files")])
def test_all_locations_of_a_common_snippet(spark, pages, name, files):
    rows = Q.QUERIES[name](spark, pages)
    got = rows.collect()
    lists = {tuple(r[files].split(", ")) for r in got if r.location_count > C.PAGE_LOCATIONS}
    assert lists and all(len(x) == FILES and list(x) == sorted(x) for x in lists)
    assert {r.location_pages for r in got if r.location_count == FILES} == {3}
    with duckdb.connect() as db:
        db.execute(f"create view pages as select * from read_parquet('{pages}/pages.parquet/*.parquet')")
        want = db.execute(f"select {', '.join(rows.columns)} from ({Q.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
