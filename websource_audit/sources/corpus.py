"""A source tree derived from stored pages: each page's text, a code snippet appended by turns, and a path from its url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import with_path_columns

#: (folder, file name, code) by turns of page_id.
SNIPPETS: tuple[tuple[str, str, str], ...] = (
    ("", "plain.html", ""),
    ("", "site.js", "function start() {\n  if (ready) { for (;;) { while (x) { y(); } } }\n  fetch('/api/users').then(show);\n}\nstart();"),
    ("views/", "Index.cshtml", "<script>\nvar u = '@Url.Action(\"Get\", \"Home\")';\n$.ajax({ url: '/api/items', dataType: 'jsonp' });\n</script>\n<div style=\"color:red\" onclick=\"go('@Model.Id')\">x</div>"),
    ("views/", "Edit.cshtml", "<script>@if (Model.Ok) { <text>var a = 1;</text> }\nfunction f() { return false; }</script>\n<a href=\"javascript:void(0)\">v</a>"),
    ("legacy/", "Default.aspx", "<asp:ScriptManager runat=\"server\" />\n<asp:UpdatePanel></asp:UpdatePanel>\n<script>__doPostBack('x','');\nPageMethods.Load(1);\nSys.WebForms.PageRequestManager.getInstance();\nnew Sys.Net.WebRequest();</script>\n<p style=\"width:<%= w %>px\">t</p>"),
    ("api/", "ItemsController.cs", "[ApiController]\n[Route(\"api/items\")]\npublic class Items {\n  [HttpGet] [WebMethod] [OperationContract]\n  void A() { Clients.All.Send(); Response.Write(\"<script>x</script>\"); HttpClient c; IJSRuntime r; new ChannelFactory<I>(); }\n}"),
    ("", "xhr.html", "<script>\nvar r = new XMLHttpRequest();\nr.onreadystatechange = f;\nr.open('GET', '/a');\nr.setRequestHeader('a', 'b');\nr.send();\nr.abort();\n</script>"),
    ("", "sockets.html", "<script>\nvar w = new WebSocket('wss://ws.example.org/live');\nvar e = new EventSource('/events');\nio('/chat');\nnew  Headers();\nnew Headers();\nnavigator.sendBeacon('/log');\n</script>"),
    ("node_modules/pkg/", "demo.html", "<script>module.exports = require('left-pad');\n$.get('https://cdn.vendor.example/x.html');</script>"),
    ("", "remote.html", "<script src=\"https://cdn.example.net/lib.js\"></script>\n<script src=\"/js/app.js\"></script>\n<link rel=\"stylesheet\" href=\"https://cdn.example.net/a.css\">\n<link rel=\"stylesheet\" href=\"css/site.css\">\n<a href=\"../up/page.html#top\">u</a> <a href=\"https://other.example.com/x\">o</a> <a href=\"/files/a.pdf\">p</a>"),
    ("", "style.php", "<style>@import url(\"https://fonts.example.net/f.css\");\np { margin: 0 }</style>\n<style></style>\n<b style=\"x\">b</b>"),
    ("a/", "b.c.html", "<script>axios.get('https://api.example.org/v1/list');\nchart.draw();</script>"),
    ("a_b/", "c.html", "<button onclick=\"validate(this)\" onmouseover=\"$('.tip').show()\">k</button>\n<form onsubmit=\"return false\" id=\"f1\"></form>"),
    ("", "template.vue", "<script>\nfetch(`${base}/users`);\n$http.post({ url: baseUrl + '/save' });\nuseQuery('k'); this.http.get('/n');\n{{ user }}\n</script>"),
    ("", "dynamic.jsx", "el.innerHTML = x; eval(c); setTimeout(f, 1); document.createElement('script');\nel.style.color = 'red'; el.classList.add('a'); styled.div``; import React from 'react';\ns.src = 'lib.js'; document.getElementById('q');"),
    ("", "jquery.html", "<script>\n$.getScript('/s');\n$('#a').load('/frag');\n$.ajaxSetup({});\n$(document).ajaxStart(f);\n$('form').serialize();\n$.post({ url: target });\nel.addEventListener('click', g);\n</script>"),
    ("", "Web.config", "<system.web.extensions>\n  <scriptResourceHandler></scriptResourceHandler>\n</system.web.extensions>"),
    ("", "Grid.aspx", "<telerik:RadAjaxManager id=\"r\" />\n<dx:ASPxCallback />\n<iframe src=\"a\" style=\"display: none\"></iframe>\n<img onerror=\"new Image('x').src = 'http://t.example.net/p.gif'\">"),
    ("", "forms.jsp", "<script>new FormData(f); new Ajax.Request('/p'); backgroundFetch; JSON.parse(s); @Ajax.BeginForm()\nhubConnection.start(); @ViewBag.Title</script>"),
    ("", "README", "no code\n"),
    ("", "bare.html", "<a href=/bare/page.html>b</a> <a class=x href='/single/page.html'>s</a> <a href=up.html#top>r</a>\n<script src=/js/bare.js></script>\n<script async src='https://cdn.example.net/s.js'></script>\n<link rel=stylesheet href=https://cdn.example.net/bare.css>"),
    ("", "quoted.html", "<a title=\"a > b\" href=\"/quoted/x\">q</a> <a title='c'href=\"/quoted/y\">r</a> <!-- <a href=\"/comment/z\">n</a> <b onclick=\"no()\"> -->\n<script>var s = '<a href=\"/script/w\">t</a>';</script>\n<a href=\"/ref/a&#x2F;b&#47;c&eacute;?d=1&amp;e\">e</a>\n<button title='1 > 0' onclick=\"if (a > b) { $.get('/gt') }\" disabled>g</button>"),
)
K = len(SNIPPETS)


def dealt_out(rows: DataFrame) -> DataFrame:
    """``rows``, moved to as many parts as there are cores if they come in fewer: what follows costs far more than the move."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files (page_id, path, rel_path, directory, filename, extension, depth, size_bytes, content) from the pages table."""
    pages = dealt_out(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    made = F.array(*(F.struct(F.lit(a).alias("folder"), F.lit(n).alias("name"), F.lit(c).alias("code")) for a, n, c in SNIPPETS))
    snip = F.element_at(made, (F.pmod(F.col("page_id"), F.lit(K)) + 1).cast("int"))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    section = F.regexp_extract("url", r"^[^:]+://[^/?#]*/([^/?#]*)", 1)
    files = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), snip.alias("s"), host.alias("host"), section.alias("section"))
    rel = F.concat("host", F.lit("/"), "section", F.lit("/"), F.col("s.folder"), F.col("page_id").cast("string"), F.lit("-"), F.col("s.name"))
    content = F.concat("html", F.lit("\n"), F.col("s.code"))
    out = files.select("page_id", "url", rel.alias("rel_path"), F.concat(F.lit("/site/"), rel).alias("path"), F.octet_length(content).cast("long").alias("size_bytes"), content.alias("content"))
    return with_path_columns(out)


def corpus_sql() -> str:
    """The same rows as a DuckDB common table expression named files."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {q(a)}, {q(n)}, {q(c)})" for k, (a, n, c) in enumerate(SNIPPETS))
    return f"""
snips(k, folder, name, code) as (values {values}),
raw as (select page_id, url, coalesce(html, '') || chr(10) || code as content,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || '/' || regexp_extract(url, '^[^:]+://[^/?#]*/([^/?#]*)', 1) || '/' || folder || page_id || '-' || name as rel_path
  from pages join snips on k = page_id % {K}),
named as (select *, '/site/' || rel_path as path, strlen(content)::bigint as size_bytes, regexp_replace(rel_path, '/[^/]*$', '') as directory, regexp_extract(rel_path, '[^/]*$') as filename from raw),
files as (select *, len(string_split(directory, '/'))::int as depth,
  case when regexp_extract(filename, '^\\.*[^.].*(\\.[^.]*)$', 1) = '' then '(No Extension)' else lower(regexp_extract(filename, '^\\.*[^.].*(\\.[^.]*)$', 1)) end as extension from named)
"""
