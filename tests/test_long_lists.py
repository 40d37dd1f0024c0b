"""Lists of a common snippet's files are in rows at the end only: no table in between has them, and files of the result hold a list once for many rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from websource_audit.operators import correlate as C
from websource_audit.plans import queries as Q
from websource_audit.sources.corpus import K

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """150 pages with one script that has a call, whose hosts are so long that the list of their files has more than 1 MB."""
    any_ = random.Random(5)
    rows = [(K * k + 6, f"https://{any_.randbytes(4500).hex()}.example/s/p{k}", "<p>x</p>") for k in range(150)]
    folder = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, PAGES).repartition(3).write.parquet(f"{folder}/pages.parquet")
    return folder


def test_correlation_matrix_reads_no_lists(spark, tmp_path):
    rows = [(K * k + 6, f"https://h.example/s/p{k}", "<p>x</p>") for k in range(C.PAGE_LOCATIONS * 2 + 5)]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = Q.QUERIES["correlation_matrix"](spark, str(tmp_path))
    whole = got.agg(F.max(F.length("static_files"))).first()[0]
    read = {os.path.dirname(f) for f in got.inputFiles()}
    assert read
    for folder in read:
        table = spark.read.parquet(folder)
        texts = [c for c, t in table.dtypes if t == "string"]
        assert max(table.agg(*(F.max(F.length(c)) for c in texts)).first()) < whole / 2


def test_rows_of_a_common_snippet_go_to_several_tasks(spark, pages, monkeypatch):
    monkeypatch.setattr(C, "ROWS_OF_A_COPY", 10, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        got = Q.QUERIES["correlate"](spark, pages).groupBy(F.spark_partition_id().alias("p"), F.md5("locations").alias("list")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len({r.list for r in got}) == 1 and sum(r["count"] for r in got) == 150 and len(got) > 1


def test_a_list_is_on_disk_once_for_many_rows(spark, pages, tmp_path):
    Q.QUERIES["correlate"](spark, pages).write.parquet(f"{tmp_path}/out")
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{tmp_path}/out") for f in names)
    back = spark.read.parquet(f"{tmp_path}/out").agg(F.sum(F.length("locations")).alias("n"), F.max(F.length("locations")).alias("one")).first()
    assert back.one > 1 << 20 and back.n == 150 * back.one and size < 10 * back.one
