import random

import pytest
from pyspark.sql import functions as F

from websource_audit.functions.html_tokens import document_findings
from websource_audit.operators import correlate as C
from websource_audit.operators import crawl as W
from websource_audit.operators import findings as D
from websource_audit.operators import inventory as I
from websource_audit.operators import refactor as R
from websource_audit.operators import reports as T
from websource_audit.plans import queries as Q
from websource_audit.sources import files as S
from websource_audit.sources import tree
from websource_audit.sources.corpus import corpus

PAGE = """<html>
<style></style><STYLE>@import url("f.css");
p{}</STYLE>
<script src="//cdn/x.js"></script><script src='app.js'></script>
<script>
var a = "</p>"; <% if %>
fetch('/a');
</script>
<b onclick="go(&quot;x&quot;)" ONCLICK="last()" style="c:<%= d %>" id=e>t</b>
<a href=" JavaScript:void(0)" style>u</a><a href='javascript:w()'>v</a>
<link rel="Alternate stylesheet" href="http://s/a.css"><link rel=icon href=i.ico><link rel="stylesheet" href="b.css"/>
<script></script>
"""


def test_tokenizer_findings():
    rows = document_findings("x.html", PAGE)
    kinds = [(r[0], r[2], r[3], r[4], r[5][:24]) for r in rows]
    assert kinds == [
        (10, "JS", "jsuri", "INLINE", '<a href=" JavaScript:voi'),
        (4, "External", "External Script", "REMOTE", "//cdn/x.js"),
        (4, "Internal", "Internal Script", "LOCAL", "app.js"),
        (5, "JS", "scriptblock", "INLINE", 'var a = "</p>"; <% if %>'),
        (9, "JS", "onclick", "INLINE", 'onclick="last()"'),
        (10, "JS", "jsuri", "INLINE", " JavaScript:void(0)"),
        (10, "JS", "jsuri", "INLINE", "javascript:w()"),
        (2, "CSS", "styleblock", "INLINE", ""),
        (2, "External", "External Style (@import)", "REMOTE", '@import url("f.css");\np{'),
        (2, "CSS", "styleblock", "INLINE", '@import url("f.css");\np{'),
        (9, "CSS", "ASP.NET Style", "INLINE", 'style="c:<%= d %>"'),
        (10, "CSS", "inlinestyle", "INLINE", 'style=""'),
        (11, "External", "External Style", "REMOTE", "http://s/a.css"),
        (11, "Internal", "Internal Style", "LOCAL", "b.css"),
    ]
    assert rows[3][1] == 6 and [r[2:5] for r in document_findings("a/b.JS", "x\ny")] == [("JS", "standalone_js", "LOCAL")]
    assert document_findings("x.html", "") == []


@pytest.fixture
def files(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "rel_path string, content string")
        df = df.select("rel_path", F.col("rel_path").alias("path"), "content", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size_bytes"))
        return S.with_path_columns(df)

    return make


def test_metrics_agree_with_details(spark):
    m = T.written(I.file_metrics(corpus(spark, "/root/testdata/sf0.001")).drop("content"), "m")
    inv, details = I.inventory(m), I.ajax_detail_rows(m)
    assert inv.agg(F.sum("AJAX_Calls_Count")).first()[0] == details.filter("Is_Counted = 'Yes'").count() == I.scan_footer(inv, details).first().ajax_calls
    assert inv.filter("(AJAX_Calls_Count > 0) <> (Has_Ajax_Calls = 'Yes')").count() == 0
    assert I.directory_stats(inv).agg(F.sum("File_Count")).first()[0] == inv.count()


def test_metrics_of_odd_files(files):
    big = "fetch(1)\n" * 1_300_000
    rows = {r.path: r for r in I.file_metrics(files([("a.html", None), ("b.html", ""), ("c.txt", "fetch(1)\n"), ("d.js", big), ("e/f.html", "<p style='x'>\n")])).collect()}
    assert rows["a.html"].Line_Count is None and (rows["a.html"].AJAX_Calls_Count, rows["a.html"].Has_Ajax_Calls) == (0, "No")
    assert (rows["b.html"].Line_Count, rows["c.txt"].AJAX_Calls_Count, rows["c.txt"].Line_Count) == (1, 0, 2)
    assert (rows["d.js"].Line_Count, rows["d.js"].AJAX_Calls_Count) == (1_300_000, 0)
    assert (rows["e/f.html"].Inline_CSS_Count, rows["e/f.html"].depth, rows["b.html"].directory) == (1, 1, "(Root)")


def test_totals_of_nothing(files):
    inv = I.inventory(I.file_metrics(files([])))
    assert {r.Value for r in I.complexity_totals(inv).collect()} == {0.0} and I.directory_stats(inv).count() == 0


def test_findings_pipeline(spark, files):
    f = T.written(D.enrich_findings(D.extract_findings(files([("v/x.html", PAGE), ("n.html", None), ("s.js", "if (a) { $.get('/q'); }")]))), "f")
    by = {(r.file_path, r.code_type): r for r in f.collect()}
    block = by["v/x.html", "scriptblock"]
    assert (block.ajax_count, block.endpoint_url, block.server_severity, block.refactor_status, block.bundled_file) == (1, "/a", "High", "Skipped (Blocked)", "v_x_html_scriptblock_L5-L6.js")
    assert block.ajax_details[0].line == 6 and block.has_server_deps and block.is_inline_ajax
    script = by["s.js", "standalone_js"]
    assert (script.complexity, script.is_inline_ajax, script.functionality) == ("Medium", False, "Data/Network Operation")
    assert D.dedup_findings(f.unionByName(f).select(*D.extract_findings(files([])).columns)).count() == f.count()
    s = T.findings_summary(f).first()
    assert (s.inline_js, s.internal_js, s.external_js, s.inline_css, s.internal_css, s.external_css, s.total) == (4, 1, 3, 2, 2, 3, 15)
    slices = [g(f).count() for g in (T.inline_js, T.internal_js, T.external_js, T.inline_css, T.internal_css, T.external_css)]
    assert slices == [4, 1, 3, 2, 2, 3] and f.count() == 15
    assert T.inline_js(f).filter("Context = 'onclick'").first().Full_Code.startswith('<b onclick="last()"')
    assert {r.Rationale for r in T.crawler_input(f).collect()} == {"Page Entry Point, Contains AJAX"}
    assert [r.Ref_ID for r in T.refactoring_tracker(f, "CSS").orderBy("Ref_ID").collect()] == [f"CSS-{k:04d}" for k in range(1, 5)]


def test_bundle_last_wins(spark):
    cols = "file_path string, rel_path string, finding_no long, category string, source_type string, bundled_file string, full_code string"
    rows = [("a/b.c", "a/b.c", 0, "JS", "INLINE", "n.js", "one"), ("a_b/c", "a_b/c", 0, "JS", "INLINE", "n.js", "two"), ("a_b/c", "a_b/c", 1, "JS", "INLINE", "n.js", "three"), ("z", "z", 0, "CSS", "LOCAL", "m.css", "")]
    assert [tuple(r) for r in T.bundle(spark.createDataFrame(rows, cols)).collect()] == [("inline_js", "n.js", "three")]


def test_row_ids_are_dense(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice("ab")) for k in rnd.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(7)
    got = T.add_row_ids(df, ["k"]).orderBy("k").collect()
    assert [r.row_no for r in got] == list(range(1, 3001))
    for g in "ab":
        part = [r.row_no for r in T.add_row_ids(df, ["k"], by="g").filter(F.col("g") == g).orderBy("k").collect()]
        assert part == list(range(1, len(part) + 1))
    assert T.add_row_ids(df.limit(0), ["k"]).count() == 0


def test_correlation_partitions_its_inputs(spark):
    f = "file_path string, finding_no long, category string, source_type string, snippet string"
    static = spark.createDataFrame([("a", 1, "JS", "INLINE", "x  = 1"), ("b", 1, "JS", "INLINE", "x = 1 "), ("c", 1, "CSS", "INLINE", "p{}"), ("d", 1, "JS", "LOCAL", "y"), ("e", 1, "JS", "INLINE", None)], f)
    dynamic = spark.createDataFrame([("u1", "x\n= 1", "t", "/a"), ("u2", "z", "t", "https://h.example/q"), ("u2", "z", "t", "https://h.example/q"), ("u3", "y", "t", "g.example/r")], "url string, snippet string, ajax_pattern string, endpoint_url string")
    index = C.static_index(static)
    rows = C.correlate(index, dynamic).collect()
    assert sorted((r.status, r.dynamic_url, r.locations) for r in rows) == [("MISSING_IN_CRAWL", "N/A", "c"), ("NEW_WEB_ONLY", "u2", "N/A"), ("NEW_WEB_ONLY", "u2", "N/A"), ("NEW_WEB_ONLY", "u3", "N/A"), ("VERIFIED", "u1", "a, b")]
    assert C.web_only(index, dynamic).count() == 3 and C.missing_in_crawl(index, dynamic).count() == 1
    assert [tuple(r) for r in C.csp_allowlist(C.correlate(index, dynamic)).collect()] == [("g.example", 1, "New", "connect-src"), ("h.example", 2, "New", "connect-src")]
    assert C.correlate(index.limit(0), dynamic.limit(0)).count() == 0


def test_correlation_by_keys_carries_no_lists(spark, monkeypatch):
    from websource_audit.plans import queries as Q

    static = spark.createDataFrame([(f"f{k:04d}", 1, "JS", "INLINE", "x = 1") for k in range(2000)] + [("c", 1, "CSS", "INLINE", "p{}")], "file_path string, finding_no long, category string, source_type string, snippet string")
    dynamic = spark.createDataFrame([(f"u{k}", "x  = 1" if k else "z", "t", "https://h.example/q") for k in range(4)], "url string, snippet string, ajax_pattern string, endpoint_url string")
    index, keys = C.static_index(static), C.static_keys(static)
    both = ("status", "dynamic_url", "ajax_type", "endpoint_url", "snippet", "location_count")
    rows = C.correlate_keys(keys, dynamic)
    assert sorted(rows.select(*both).collect()) == sorted(C.correlate(index, dynamic).select(*both).collect())
    assert max(len(str(r)) for r in rows.collect()) < 300
    assert sorted((r.file, r.row) for r in rows.filter("dynamic_url = 'u1'").join(C.static_locations(static), "h").collect()) == [(f"f{k:04d}", 1) for k in range(2000)]
    monkeypatch.setattr(Q, "_dynamic", lambda *_: dynamic)
    monkeypatch.setattr(Q, "_keys", lambda *_: keys, raising=False)
    monkeypatch.setattr(Q, "_index", lambda *_: 1 / 0)
    assert [tuple(r) for r in Q.QUERIES["csp_allowlist"](spark, "").collect()] == [("h.example", 4, "New, Verified", "connect-src")]


def test_crawl(spark):
    pages = spark.createDataFrame([("http://h/a/b", '<a href="../c#x">1</a><A class=z HREF=\'/d.PNG\'>2</A><a href="http://o/e">3</a><a href="f?x=1&amp;y=2"><script src="//h/s.js"></script><script src="t.js"></script><link href="http://o/q.css" rel="stylesheet">'), ("http://h/c", "<a name=n>"), ("http://h/n", None)], "url string, content string")
    assert {r.dst_url for r in W.page_links(pages).collect()} == {"http://h/c", "http://h/a/f?x=1&y=2"}
    assert {tuple(r) for r in W.discover_assets(pages).collect()} == {("http://h/a/b", "html"), ("http://h/c", "html"), ("http://h/n", "html"), ("http://h/s.js", "js"), ("http://h/a/t.js", "js")}
    assert [tuple(r) for r in W.external_assets(pages).collect()] == [("http://h/a/b", "http://o/q.css", "Stylesheet")]
    bare = spark.createDataFrame([("http://h/p", "<a href=/x>1</a><a id=k href='/y'>2</a><script src=/s.js></script><link rel=stylesheet href=http://o/q.css><link href=http://o/i.png rel='icon'>")], "url string, content string")
    assert {r.dst_url for r in W.page_links(bare).collect()} == {"http://h/x", "http://h/y"}
    assert {r.url for r in W.discover_assets(bare).collect()} == {"http://h/p", "http://h/s.js"} and [r.url for r in W.external_assets(bare).collect()] == ["http://o/q.css"]
    links = spark.createDataFrame([(str(k), str(k + 1)) for k in range(10)] + [("2", "0"), ("0", "4")], "src_url string, dst_url string")
    got = {r.url: r.depth for r in W.crawl_reach(links, spark.createDataFrame([("0",), ("0",)], "url string")).collect()}
    assert got == {"0": 0, "1": 1, "4": 1, "2": 2, "5": 2, "3": 3, "6": 3, "7": 4, "8": 5}


def test_resolve_original_files(spark):
    rnd = random.Random(2)
    names = ["".join(rnd.choice("ab/_") for _ in range(rnd.randint(1, 14))) for _ in range(60)]
    blocks = ["".join(rnd.choice("ab_") for _ in range(rnd.randint(1, 14))) for _ in range(80)] + [n.replace("/", "_") for n in names[:10]]
    clean = [(n, n.replace("/", "_")) for n in names]
    want = {}
    for b in set(blocks):
        same = [n for n, s in clean if s == b]
        like = [n for n, s in clean if s.endswith(b) or b.endswith(s)]
        want[b] = min(same) if same else like[0] if len(like) == 1 else None
    got = R.resolve_original_file(spark.createDataFrame([(b,) for b in blocks + [None]], "block_path string"), spark.createDataFrame([(n,) for n in names], "rel_path string")).collect()
    assert {r.block_path: r.rel_path for r in got} == want and len(got) == len(want)


def test_plan_and_index(spark, files):
    f = D.enrich_findings(D.extract_findings(files([("p.html", "<script>a()</script><script>'@Model.X'</script><script>@if (b) {}</script><i onclick='c()' onload='d()' id='k'></i>")])))
    plan = R.refactor_plan(f)
    assert sorted((r.action, r.element_id or "") for r in plan.collect()) == [("bridge", ""), ("leave", ""), ("listener", "k"), ("listener", "k"), ("todo", "")]
    assert R.bottom_scripts(plan).first().n_scripts == 2
    one = R.refactorability_index(R.assessment_rows(R.extracted_blocks(f))).first()
    assert (one.total, one.clean, one.bridge, one.inline) == (5, 3, 1, 2) and one.refactorability == 112.0
    assert R.refactorability_index(R.assessment_rows(R.extracted_blocks(f.limit(0)))).first().refactorability == 0


def test_reconcile_and_origins(spark):
    a, b = spark.createDataFrame([(3, 4)], "x long, y long"), spark.createDataFrame([(5, 1)], "x long, z long")
    assert sorted(tuple(r) for r in T.reconcile(a, b).collect()) == [("x", 3, 5, 2), ("y", 4, 0, -4), ("z", 0, 1, 1)]
    s = spark.createDataFrame([("p", "r", "Script")], "page string, resource string, type string")
    assert tuple(W.resource_origins(s, s).first()) == ("p", "r", "Script", "Dynamic, Static", "script-src")


def test_source_tree_and_reports(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "a.js").write_bytes(b"x\r\ny")
    (root / "sub" / "b.html").write_bytes("café".encode("windows-1252"))
    (root / "sub" / "c").write_bytes(b"\x81\x8d")
    rows = {r.rel_path: r for r in S.decode_content(S.read_source_tree(spark, str(root))).collect()}
    assert {k: (r.content, r.encoding) for k, r in rows.items()} == {"a.js": ("x\ny", "utf-8"), "sub/b.html": ("café", "windows-1252"), "sub/c": ("\x81\x8d", "latin-1")}
    assert (rows["a.js"].directory, rows["sub/c"].extension, rows["a.js"].size_bytes) == ("(Root)", "(No Extension)", 4)
    (root / "Views" / "Shared").mkdir(parents=True)
    (root / "_partials").mkdir()
    (root / ".git").mkdir()
    for name, data in (("Views/Shared/_Layout.cshtml", b"<b>"), (".htaccess", "déjà".encode("utf-16")), ("_partials/x.html", b""), (".git/config", b"no")):
        (root / name).write_bytes(data)
    for top in (str(root), root.as_uri().replace("file:///", "file:///") + "/"):
        found = {r.rel_path: (r.content, r.encoding, r.size_bytes) for r in S.decode_content(S.read_source_tree(spark, top)).collect()}
        assert set(found) == {"a.js", "sub/b.html", "sub/c", "Views/Shared/_Layout.cshtml", ".htaccess", "_partials/x.html"}
        assert found["Views/Shared/_Layout.cshtml"] == ("<b>", "utf-8", 3) and found[".htaccess"][:2] == ("déjà", "utf-16") and found["_partials/x.html"] == ("", "utf-8", 0)
    assert {r.rel_path for r in S.read_source_tree(spark, str(root), by_spark=True).collect()} == {"a.js", "sub/b.html", "sub/c"}
    assert {r.rel_path for r in S.read_source_tree(spark, str(root), max_bytes=3).collect()} == {"sub/c", "Views/Shared/_Layout.cshtml", "_partials/x.html"}
    raw = spark.createDataFrame([(b"a\xffb\r\n",)], "c binary")
    assert raw.select(S.decode_ignoring(F.col("c"))).first()[0] == "ab\n"
    S.write_report({"t": spark.range(3)}, str(tmp_path / "r"))
    first = S.read_report(spark, str(tmp_path / "r"), "t")
    S.write_report({"t": spark.range(2)}, str(tmp_path / "r"))
    assert S.read_report(spark, str(tmp_path / "r"), "t").count() == 2 and first.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        S.write_report({"t": spark.range(1), "u": spark.range(4).select(F.raise_error(F.lit("no")).alias("x"))}, str(tmp_path / "r"))
    assert S.read_report(spark, str(tmp_path / "r"), "t").count() == 2 and S.report_versions(spark, str(tmp_path / "r")).count() == 2
    S.write_extracted_code(spark.createDataFrame([("inline_js", "n", "c")], "folder string, file_name string, full_code string"), str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).first().folder == "inline_js"
    latest = S.latest_report(spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "path string, modified long"))
    assert latest.first().path == "b"


def test_registry():
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES) and len(Q.QUERIES) > 50


def test_row_ids_of_ties_nulls_and_parts(spark):
    rows = [(None, "x"), (5, None), (5, "x"), (5, "x"), (None, None), (1, "y")] * 20
    df = spark.createDataFrame(rows, "k long, g string").repartition(5)
    for parts in (1, 3, 40):
        got = T.add_row_ids(df, ["k"], parts=parts).collect()
        assert sorted(r.row_no for r in got) == list(range(1, 121))
        assert [r.k for r in sorted(got, key=lambda r: r.row_no)] == [None] * 40 + [1] * 20 + [5] * 60
        by = {}
        for r in T.add_row_ids(df, ["k"], by="g", parts=parts).collect():
            by.setdefault(r.g, []).append(r.row_no)
        assert {g: sorted(n) for g, n in by.items()} == {g: list(range(1, n + 1)) for g, n in ((None, 40), ("x", 60), ("y", 20))}


def test_a_snippet_of_a_third_of_all_files(spark):
    """Rows stay bounded: locations come in pages, and correlated rows carry the first one."""
    f = "file_path string, finding_no long, category string, source_type string, snippet string"
    files = [(f"f{k:04d}", k % 3, "JS", "INLINE", "hot  x" if k % 3 == 0 else f"s{k}") for k in range(900)]
    index = C.written(C.static_index(spark.createDataFrame(files, f), page_size=40), "index")
    pages = sorted(index.filter("norm = 'hot x'").collect(), key=lambda r: r.page)
    assert [len(r.locations) for r in pages] == [40] * 7 + [20] and {r.location_count for r in pages} == {300}
    assert [x.file for r in pages for x in r.locations] == [f"f{k:04d}" for k in range(0, 900, 3)]
    dynamic = spark.createDataFrame([(f"u{k}", "hot x", "t", "/a") for k in range(300)] + [("v", "s1", "t", "/a")], "url string, snippet string, ajax_pattern string, endpoint_url string")
    rows = C.correlate(index, dynamic).collect()
    hot = [r for r in rows if r.snippet == "hot x"]
    assert len(hot) == 300 and all(r.location_count == 300 and r.location_pages == 8 and r.locations.count(", ") == 39 for r in hot)
    assert sum(r.status == "MISSING_IN_CRAWL" for r in rows) == 599 and {(r.location_count, r.location_pages) for r in rows if r.dynamic_url == "v"} == {(1, 1)}


def test_a_name_of_a_third_of_all_files(spark):
    """Names that only share an end do not meet, and a key is one row however many files have it."""
    files = spark.createDataFrame([(f"d{k}/Index.cshtml" if k % 3 == 0 else f"e{k}/p{k}.html",) for k in range(600)], "rel_path string")
    blocks = spark.createDataFrame([("Index.cshtml",), ("p1.html",), ("x_e4_p4.html",), ("ndex.cshtm",), ("d3_Index.cshtml",)], "block_path string")
    got = {r.block_path: r.rel_path for r in R.resolve_original_file(blocks, files).collect()}
    assert got == {"Index.cshtml": None, "p1.html": "e1/p1.html", "x_e4_p4.html": "e4/p4.html", "ndex.cshtm": None, "d3_Index.cshtml": "d3/Index.cshtml"}
    assert R.resolve_original_file(blocks.limit(0), files).count() == 0 and R.resolve_original_file(blocks, files.limit(0)).filter("rel_path is not null").count() == 0


def test_links_of_quoted_parts_comments_and_references(spark):
    html = """<a title="a > b" href="/x">1</a><a title='y'href="/y">2</a><!-- <a href="/c">3</a> --><script>var s = '<a href="/s">4</a>';</script>
<A HREF=/&eacute;&#x41;&amp;copy=1&copy>5</A><abbr href="/no">6</abbr><a href="/1" href="/2">7</a><a name=z>8</a><a data-href="/d" href = '/w w'>9</a><a href="/open>"""
    pages = spark.createDataFrame([("http://h/p", html), ("http://h/q", None)], "url string, content string")
    assert [r.href for r in W.raw_links(pages).collect()] == ["/x", "/y", "/éA&copy=1©", "/2", "/w w"]
    page = """<script a=">" src="/a.js"></script><script>"<script src='/b.js'>"</script><link title="x > y" rel="x Stylesheet" href=/c.css><link rel=icon href=/d.ico>"""
    pages = spark.createDataFrame([("http://h/p", page)], "url string, content string")
    assert [r.target for r in W.script_sources(pages).collect()] == ["http://h/a.js"]
    assert [r.target for r in W.stylesheet_links(pages).collect()] == ["http://h/c.css"]
    assert W.raw_links(pages.limit(0)).count() == 0
    long = spark.createDataFrame([("http://h/p", "<a " + 'x="> " ' * 60000 + 'href="/far">t</a>')], "url string, content string")
    assert [r.href for r in W.raw_links(long).collect()] == ["/far"]


def test_findings_as_table_function(spark, files):
    D.register_findings(spark)
    frame = files([("p.html", PAGE), ("q.js", "x()"), ("r.html", None)])
    frame.createOrReplaceTempView("audited")
    columns = "file_path, finding_no, start_line, code_type, full_code"
    got = spark.sql("select path as file_path, f.finding_no, f.start_line, f.code_type, f.full_code from audited, lateral html_findings(path, content) f")
    want = D.extract_findings(frame).select(*columns.split(", "))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_tree_source_shares_folders_out_and_opens_no_large_file(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"d{k}" / "deep" / "er").mkdir(parents=True)
        for n, name in ((5, "a.js"), (50, "b.js")):
            (tmp_path / f"d{k}" / "deep" / "er" / name).write_bytes(b"x" * n)
    (tmp_path / "top.js").write_bytes(b"y")
    want = sorted([f"d{k}/deep/er/{n}.js" for k in range(6) for n in "ab"] + ["top.js"])
    for fan in (1, 5, 256):
        monkeypatch.setattr(tree, "FAN_OUT", fan)  # on the driver
        reader = tree.TreeReader({"path": str(tmp_path)})
        parts = reader.partitions()
        assert len(parts) == {1: 1, 5: 7, 256: 19}[fan]
        assert sorted(b.column("rel_path")[0].as_py() for p in parts for b in reader.read(p)) == want
    spark.conf.set(tree.PUSHDOWN, "true")
    try:
        small = tree.load_tree(spark, str(tmp_path)).filter("length <= 5 and rel_path <> 'top.js'")
        assert sorted(r.rel_path for r in small.collect()) == [w for w in want if w.endswith("a.js")]
        pushed = tree.PushingReader({"path": str(tmp_path), "maxBytes": "9"})
        assert [*pushed.pushFilters([tree.LessThan(("length",), 6), tree.LessThanOrEqual(("other",), 1)])] == [tree.LessThanOrEqual(("other",), 1)] and pushed.most == 5
    finally:
        spark.conf.unset(tree.PUSHDOWN)
    assert tree.load_tree(spark, str(tmp_path), content=False).filter("content is null").count() == 13
    (tmp_path / "none").mkdir()
    assert tree.load_tree(spark, str(tmp_path / "none")).count() == 0


def test_decoding_equals_pythons(spark):
    rnd = random.Random(4)

    def plain(raw):
        for name in ("utf-8", *(("utf-16",) if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else ()), "windows-1252", "latin-1"):
            try:
                return raw.decode(name).replace("\r\n", "\n").replace("\r", "\n"), name
            except UnicodeDecodeError:
                continue

    rows = [bytes(rnd.choice(b"ab\r\n\x80\x93\x9f\xe9\x81" if k % 2 else b"ab\x80\x93\x9f\xe9") for _ in range(rnd.randint(0, 9))) for k in range(200)]
    rows += [bytes(range(256)), bytes(x for x in range(128, 256) if x not in b"\x81\x8d\x8f\x90\x9d")]
    for text in ("", "a\u20acb\r\nc", "\U0001f600x" * 3):
        rows += [b"\xff\xfe" + text.encode("utf-16-le"), b"\xfe\xff" + text.encode("utf-16-be")]
    rows += [b"\xff\xfea", b"\xff\xfe\x00\xd8", b"\xff\xfe\x00\xdc\x00\xd8", b"\xfe\xff\xd8\x00\x00a", b"\xff\xfe" + "long".encode("utf-16-le") * 50000]
    table = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(rows)] + [(-1, None)], "k int, bytes binary")
    got = {r.k: (r.content, r.encoding) for r in S.decode_content(table).collect()}
    assert got.pop(-1) == (None, None)
    assert got == {k: plain(r) for k, r in enumerate(rows)}
