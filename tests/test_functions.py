import os
import posixpath
import random
import re
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from websource_audit.functions import ajax, paths, scoring
from websource_audit.functions import patterns as P


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first()["x"]


NAMES = ["a.js", "A.B.HTML", ".bashrc", "..x.y", "README", "a.", ".a.b", "x.tar.gz", "é.Js"]


def test_extension_like_splitext(spark):
    for n in NAMES:
        assert one(spark, n, paths.extension) == (os.path.splitext(n)[1].lower() or "(No Extension)"), n


def test_directories(spark):
    for p, d, k in (("a.js", "(Root)", 0), ("x/a.js", "x", 1), ("x/y.z/a", "x/y.z", 2)):
        assert one(spark, p, paths.directory) == d
        assert one(spark, p, lambda c: paths.directory_depth(paths.directory(c))) == k
        assert one(spark, p, paths.filename) == posixpath.basename(p)


def test_size_and_lines(spark):
    for n in (0, 1, 1152, 1280, 5_000_001):
        assert one(spark, n, paths.size_kb, "long") == round(n / 1024, 2)
    rows = spark.createDataFrame([("", 0), ("a", 1), ("a\n", 2), ("a\nb\n", 11 * 2**20), ("a\nb", 11 * 2**20)], "c string, n long")
    assert [r.x for r in rows.select(paths.line_count(F.col("c"), F.col("n")).alias("x")).collect()] == [1, 1, 2, 2, 2]


def test_globs(spark):
    df = spark.createDataFrame([("jquery-1.js",), ("my.jquery.js",), ("a+b.js",), ("ab.js",), ("x1.js",)], "filename string")
    kept = lambda *g: [r[0] for r in paths.filter_exclude_globs(df, g).collect()]
    assert kept("jquery*.js") == ["my.jquery.js", "a+b.js", "ab.js", "x1.js"]
    assert kept("a+b.*", "x[0-9].js") == ["jquery-1.js", "my.jquery.js", "ab.js"]
    assert kept("a?b.js", "[!a]*") == ["ab.js"]


@pytest.mark.parametrize("base", ["http://h.example/a/b?x=1#f", "https://h.example", "http://h.example/a/b/"])
def test_resolve_url_like_urljoin(spark, base):
    hrefs = ["c", "../c", "./c.html#z", "/r", "/r/../s", "//o.example/x", "https://O.example/p/q", "?q=2", "#top", "", "mailto:a@b", "javascript:x()", "http://h.example", "/a b", "HTTP://x.example/y", "a;b?c", "//o.example"]
    got = [r.x for r in spark.createDataFrame([(base, h) for h in hrefs], "b string, h string").select(paths.resolve_url(F.col("b"), F.col("h")).alias("x")).collect()]
    assert got == [urljoin(base, h).split("#")[0] for h in hrefs]
    assert urldefrag(base)[0] is not None


def test_csp_domain(spark):
    cases = {None: "Manual Review Required", "": "Manual Review Required", "Unknown/Dynamic": "Manual Review Required", "/api": "Self", "https://a.example/x": "a.example", "api.b.example/v1": "api.b.example", "users": "Self (Assumed)", "wss://c.example:1/": "c.example:1"}
    for e, want in cases.items():
        assert one(spark, e, paths.csp_domain) == want


LINES = [
    ("new XMLHttpRequest(", "Construct", "XHR Construct", "No", "No"), (".setRequestHeader(", "Config", "Request Header Manipulation", "No", "No"), (".abort(", "Utility", "Request Control", "No", "No"), ("new Headers(", "Construct", "Fetch API Construct", "No", "No"),
    ("fetch(", "Request", "Data Exchange", "Yes", "Yes"), ("JSON.parse(", "Utility", "JSON Utility", "No", "No"), ("[ApiController]", "Server", "API Endpoint (Server)", "No", "No"), ("[WebMethod]", "Server", "AJAX Endpoint (Server)", "No", "No"),
    ("ScriptManager.RegisterStartupScript(", "Server", "Server-Side Script Injection", "No", "No"), ("@Ajax.ActionLink", "Request", "Razor AJAX Helper", "Yes", "Yes"), ("<system.web.extensions>", "Config", "AJAX Configuration", "No", "No"),
    ("<telerik:RadAjaxManager", "Third-Party", "Telerik AJAX Control", "Yes", "Yes"), (".open('GET'", "Construct", "XHR Construct", "No", "Yes"), ("new WebSocket(", "Construct", "Real-time Construct", "Yes", None), ("new  Headers(", "Request", "Data Exchange", "Yes", "Yes"),
    ("PageMethods.X(", "Request", "RPC (Code-Behind)", "Yes", "Yes"), ("data-ajax-mode=", "Request", "Declarative AJAX", "Yes", "Yes"), ("dataType: 'jsonp'", "Legacy Pattern", "JSONP (Legacy Cross-Domain)", "Yes", "Yes"),
]


def test_classification(spark):
    for text, category, capability, depth, static in LINES:
        r = one(spark, text, lambda c: ajax.classify(c, "depth"))
        assert (r.category, r.capability, r.is_counted) == (category, capability, depth), text
        s = one(spark, text, lambda c: ajax.classify(c, "static"))
        if static is None:
            assert (s.category, s.capability, s.is_counted) == ("Request", "Data Exchange", "Yes")
        else:
            assert s.is_counted == static
    with pytest.raises(ValueError):
        ajax.classify(F.lit("x"), "other")


def test_match_lines_equal_python_positions(spark):
    code = "x\nfetch (a);\r\n\nnew\n XMLHttpRequest(); $.get('a'); io(1)\n<iframe a style=\"b display: none\">\nfetch(2)é fetch(3)"
    want = [(code.count("\n", 0, m.start()) + 1, m.group()) for m in re.finditer(P.AJAX, code, re.IGNORECASE)]
    assert [(m.line, m.text) for m in one(spark, code, ajax.ajax_matches)] == want and len(want) == 7


def test_matches_between_plain_text(spark):
    """The alternation entered by two characters matches what it matches at every place, whatever folds to these characters."""
    rnd = random.Random(3)
    parts = ["fetch(1)", "new\n Request", ";JSON(", ".JSON(", "Response.Write('<script", "<p>At onorou.\n Onon</p>", "plain words of prose; ", "{ }\n\n", "ChannelFactory<", "news io tion", "io (2)", "po\u017ft $.po\u017ft(", "\u0130O(", "\u0131o(", "J\u017fON.par\u017fe(", "\u017fy\u017f.Net.WebReque\u017ft(", "IJ\u017fRuntime", "<x:UpdatePanel", ".src\n=\n'http", "a\u0001b"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(200)] + ["<iframe a;b<c style='x'>d;e{display:  none"]
    texts.append("fetch(\n);\n" * 3000)
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select("c", ajax.ajax_matches(F.col("c")).alias("m"), ajax.matches(F.col("c"), P.AJAX).alias("w")).collect()
    assert all(r.m == r.w for r in rows) and sum(len(r.m) for r in rows) > 3200
    assert [(m.line, m.text) for m in rows[-1].m] == [(2 * k + 1, "fetch(") for k in range(3000)]


def test_every_alternative_is_entered(spark):
    texts = ["fetch(", "new XMLHttpRequest(", "http . request(", ".load(", ".open('GET'", "onreadystatechange =", ".send(", "axios(", "new WebSocket(", "new EventSource(", "ajax: function", "navigator.sendBeacon(", "new ActiveXObject(", "IO (", "HubConnectionBuilder", "Sys.Net.WebRequest(", "PageMethods.a(", "__doPostBack(",
             "Sys.WebForms.PageRequestManager", "data-ajax=", ".setRequestHeader(", ".abort(", ".getResponseHeader(", ".getAllResponseHeaders(", "new Headers(", "new Request(", "JSON.parse(", "JSON.stringify(", "<a:UpdatePanel", "<a:ScriptManager", "ClientScript.RegisterStartupScript(", "Page.ClientScript.", "[WebMethod]", "[ScriptMethod]",
             "[WebService]", "[OperationContract]", "[ApiController]", "[Route('api/", "[HubName]", "hubConnection.start(", "Clients.All", "Clients.Caller", "@Ajax.BeginForm", "@Url.Action(", "@Url.Content(", "<system.web.extensions>", "<scriptResourceHandler>", "<telerik:RadAjaxPanel", "RadAjaxManager", "ASPxCallback", "$http", "this.http.get(",
             "useQuery(", "useMutation(", "new Ajax.Request(", "dataType: 'jsonp'", "Response.Write('<script", "ChannelFactory<", "HttpClient x", "IJSRuntime", "[HttpGet]", "backgroundFetch", "target='_iframe'", "<iframe style='display:none", "new FormData", "new Image(", ".src = 'http"]
    rows = spark.createDataFrame([(t.upper() if t.upper() != t else t,) for t in texts], "c string").select("c", ajax.ajax_matches(F.col("c")).alias("m")).collect()
    assert [r.c for r in rows if not r.m] == []


def test_endpoints(spark):
    cases = [("fetch('/api/users')", "fetch(", "/api/users"), ("fetch(`${U}/posts`)", "fetch(", "${U}/posts"), ("x.send()", ".send(", "Unknown/Dynamic"), ("$.get('@Url.Action(\"G\")')", "$.get(", "@Url.Action("), ("axios.post(\"/p\")", "axios.post(", "/p"), ("$.ajax({url: '@x'})", "$.ajax(", "Server-Generated"), ("$.ajax({url: a + '/b'})", "$.ajax(", "a + '/b'"), ("$.ajax({url: target })", "$.ajax(", "Dynamic/Variable"), ("$.ajax({url: `t${x}`})", "$.ajax(", "t${x}"), (" " * 1000 + "fetch('/far')", "fetch(", "Unknown/Dynamic")]
    for code, m, want in cases:
        assert one(spark, code, lambda c, m=m: ajax.endpoint(c, F.lit(m))) == want, code


def test_scores(spark):
    density = lambda code, a=False: one(spark, code, lambda c: scoring.logic_density_score(c, F.lit(a)))
    assert density("document.getElementById('x')") == -2 and density("$('a'); if (b) {}") == 2 and density("function f() {} for(;;){}", True) == 5 and density("") == 0
    assert [one(spark, n, scoring.complexity, "int") for n in (-2, 2, 5)] == ["Low", "Medium", "High"]
    assert [one(spark, c, scoring.server_severity) for c in ("@model.x", "<% if", "@Url.X", "<%=x", "x")] == ["High", "High", "Medium", "Low", "None"]
    work = lambda c: one(spark, c, lambda x: scoring.functionality(x, F.lit(False)))
    assert [work(c) for c in ("Validate()", "a.hover", "chart", "x.show()", "q")] == ["Form Validation", "UI Interaction", "Data Visualization", "Visual Effects", "General Logic"]
    d = one(spark, "eval(x); a.innerHTML = b; el.style.top = 1", scoring.dynamic_code)
    assert (d.dynamic_count, d.dynamic_pattern, d.dynamic_code_detected) == (3, "dom_sink", True)


def test_extracted_names_and_states(spark):
    r = one(spark, "Views_Home_Index.cshtml_scriptblock_line10-25.js", scoring.parse_extracted_filename)
    assert tuple(r) == ("Views/Home/Index.cshtml", "10-25", "scriptblock", 10, 25)
    assert tuple(one(spark, "x.js", scoring.parse_extracted_filename)) == ("x.js", "Unknown", "Unknown", 0, 0)
    for name, code, want in (
        ("a.js", "var a;", ("A", "High", "Ready", 0, "No")), ("a.js", "u = '@Url.Action(\"x\")'; $.get(u)", ("B", "Medium", "Bridgeable", 1, "Yes")), ("a.js", "@IF (x) { }", ("C", "Low", "Blocked", 0, "No")),
        ("a.css", "p{background:@Url.Content('~/a.png')}", ("C", "Low", "Blocked", 1, "No")), ("a.css", "p{color:@Model.Color}", ("B", "Medium", "Bridgeable", 1, "No")), ("a.css", "p{}", ("A", "High", "Ready", 0, "No")),
    ):
        r = one(spark, code, lambda c, name=name: scoring.classify_code(F.lit(name), c))
        assert (r.state, r.complexity, r.status, r.razor_tokens, r.is_ajax) == want, code
