"""The registered queries of operators without SQL, over a whole table, against plain Python."""

import hashlib
import os
import zlib

import pytest
from packing_checks import check_packing, ids_of

from websource_audit.llm import packing, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_op6(spark, texts):
    want = {}
    for d, t in texts:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want[d] = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    rows = queries.op6_tiff(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want and len(rows) == len(texts)
    assert all(r.error is None and r.media_bytes > 0 for r in rows)


def test_op9(spark, texts):
    rows = queries.op9_best_fit(spark, SF).collect()
    used = check_packing(rows, texts, packing.CAPACITY)
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) + 1 for _, t in texts)
    assert used <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_op9_null_ids_repeated_rows_and_clashing_columns(spark, documents):
    rows = [(None, "a b c"), (None, None), (1, "x " * 200), (1, "x " * 200), (2, ""), (2, "other text")]
    docs = documents(rows).selectExpr("*", "1 as piece", "2 as length", "3 as task", "4 as rank", "5 as d", "6 as t")
    out = packing.pack(docs.repartition(3), 64).collect()
    assert sum(r.length for r in out) == sum(len(ids_of(t)) + 1 for _, t in rows)
    assert sum(r.length for r in out if r.doc_id is None) == len(ids_of("a b c")) + 2
    assert sum(r.length for r in out if r.doc_id == 1) == 2 * (len(ids_of("x " * 200)) + 1)
    by = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 64
