import glob
import gzip
import hashlib
import random

import numpy as np

from websource_audit.llm import warc as A

P = "page_id long, url string, html string"


def test_round_trip_and_revisits(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "é" * 60
    rows = [(1, "http://a/1", long), (2, "http://a/2", fake * 3), (3, None, None), (4, "http://a/4\r\nX: y", ""), (5, "u", long), (0, "u0", "short"), (6, "u6", "short"), (7, "u7", "z" * 100_000), (8, "u8", long), (9, "u9", "WARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, P).withColumnRenamed("x", "x").repartition(3)
    folder = A.write_archives(pages, str(tmp_path / "w"), file_records=2)
    got = {r.page_id: r for r in A.resolve_revisits(A.read_archives(spark, folder)).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 1, 8: 1}
    assert got[4].url == "http://a/4%0D%0AX: y" and got[3].url is None


def test_repeated_ids(spark, tmp_path):
    """Equal rows, and one id with two payloads: each record comes back once with its own digest."""
    a, b = "a" * 200, "b" * 200
    rows = [(1, "u", a), (1, "u", a), (1, "u", b), (2, "v", a), (3, "w", b)]
    folder = A.write_archives(spark.createDataFrame(rows, P), str(tmp_path / "r"))
    got = A.resolve_revisits(A.read_archives(spark, folder)).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((r.page_id, r.payload_digest, r.refers_to) for r in got) == sorted([(1, digest(a), None), (1, digest(a), None), (1, digest(b), None), (2, digest(a), 1), (3, digest(b), 1)], key=str)


def test_empty_and_null_ids(spark, tmp_path):
    none = spark.createDataFrame([], P)
    assert A.with_revisits(none).count() == 0
    folder = A.write_archives(spark.createDataFrame([(None, "u", "x" * 200), (None, None, None)], P), str(tmp_path / "n"))
    assert [r.page_id for r in A.read_archives(spark, folder).collect()] == [None, None]


def test_pointer_jumping_equals_walking():
    rnd = random.Random(4)
    for _ in range(200):
        at = sorted(rnd.sample(range(1, 60), rnd.randint(0, 25)))
        at = [0, *at] if rnd.random() < 0.8 else at
        nxt = [rnd.choice([x for x in at if x > a] + [a + 1, 99]) for a in at]
        want, here = set(), 0
        while here in at:
            want.add(here)
            here = nxt[at.index(here)]
        got = A.reachable(np.array(at, np.int64), np.array(nxt, np.int64))
        assert {a for a, ok in zip(at, got, strict=True) if ok} == want


def test_damaged_and_plain_files(spark, tmp_path):
    folder = A.write_archives(spark.createDataFrame([(k, "u", f"body {k}") for k in range(6)], P).coalesce(1), str(tmp_path / "d"), file_records=100)
    (path,) = glob.glob(f"{folder}/part-*")
    data = gzip.open(path).read()
    places = [r[0] for r in A.candidates(data)]
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "cut.warc").write_bytes(data[: places[4] + 20])
    (plain / "late.warc").write_bytes(b"x" + data)
    rows = A.read_archives(spark, str(plain)).collect()
    assert sorted(r.page_id for r in rows) == [0, 1, 2, 3]


def test_heads_inside_payloads_are_not_hashed():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n"
    inner = b"".join(head % 5 + b"x" * 40 for _ in range(50))
    data = head % len(inner) + inner + b"\r\n\r\n" + head % 3 + b"abc\r\n\r\n"
    rows = list(A.candidates(data))
    assert len(rows) == 52
    kept = [r for r, on in zip(rows, A.reachable(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])), strict=True) if on]
    assert [r[-1] for r in kept] == [hashlib.sha256(inner).hexdigest(), hashlib.sha256(b"abc").hexdigest()]
    assert sum(r[-1] is not None for r in rows) == 2


def test_large_payloads_have_files_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://s/{k}", "p" * n + str(k)) for k, n in enumerate([10, 5000, 20, 6000, 30, 5000])], "page_id long, url string, html string")
    path = A.write_archives(pages.coalesce(1), str(tmp_path / "w"), large_bytes=1000)
    rows = A.read_archives(spark, path).collect()
    by = {}
    for r in rows:
        by.setdefault(r.archive, []).append(r.page_id)
    assert sorted(map(sorted, by.values())) == [[0, 2, 4], [1], [3], [5]]
