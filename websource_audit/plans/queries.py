"""One query for each operator of the audit, over the whole corpus derived from pages, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ajax, paths, scoring
from ..functions import patterns as P
from ..operators import correlate as C
from ..operators import crawl as W
from ..operators import findings as D
from ..operators import inventory as I
from ..operators import refactor as R
from ..operators import reports as T
from ..sources.corpus import corpus, corpus_sql
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL for the same rows if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.file_metrics(corpus(spark, sf_dir))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.inventory(_metrics(spark, sf_dir))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.enrich_findings(D.block_findings(corpus(spark, sf_dir)))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.enrich_findings(D.extract_findings(corpus(spark, sf_dir)))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as stored pages."""
    return corpus(spark, sf_dir).select("url", "content")


METRICS_SQL, FILES_SQL = O.metrics_sql(), f"with {corpus_sql()}"
BLOCKS_SQL, HTML_SQL = f"with {corpus_sql()}, {O.blocks_sql()}", f"with {corpus_sql()}, {O.html_sql()}"

# --- files and inventory -------------------------------------------------------------------------------------------


@query(METRICS_SQL + 'select path, counted.filename, counted.directory, counted.extension, depth, size_bytes, i.* exclude ("Directory", "Filename", "Extension", "Full_Path") from counted join inv i on path = "Full_Path"')
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("path", "filename", "directory", "extension", "depth", "size_bytes", "Size_KB", "Line_Count", *I.METRICS, "Has_Ajax_Calls")


@query(METRICS_SQL + """, e as (select "Directory", "Extension", count(*) as n, sum("Line_Count") as lines from inv group by 1, 2)
select "Directory", len(string_split("Directory", '/'))::int as "Depth", sum(n)::bigint as "File_Count", sum(lines)::bigint as "Total_Lines", string_agg("Extension" || ': ' || n, ', ' order by "Extension") as "Extensions_Breakdown" from e group by 1""")
def directory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.directory_stats(_inventory(spark, sf_dir))


@query(METRICS_SQL + "select * from details")
def ajax_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ajax_detail_rows(_metrics(spark, sf_dir))


@query(METRICS_SQL + f"""select m as text, {ajax.classify_sql('m', 1, 'static')} as category, {ajax.classify_sql('m', 0, 'static')} as capability, {ajax.classify_sql('m', 3, 'static')} as difficulty, {ajax.classify_sql('m', 2, 'static')} as is_counted, count(*) as n
from {O.with_matches('files', 'content', P.AJAX)} group by all""")
def classify_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = corpus(spark, sf_dir).select(F.explode(ajax.ajax_matches(F.col("content"))).alias("m")).select("m.text")
    return m.select("text", ajax.classify(F.col("text"), "static").alias("c")).groupBy("text", "c.category", "c.capability", "c.difficulty", "c.is_counted").agg(F.count(F.lit(1)).alias("n"))


@query(METRICS_SQL + """select unnest(['Total_Files', 'Total_Lines', 'Total_Size_MB', 'Files_With_Ajax']) as "Metric", unnest([count(*)::double, sum("Line_Count")::double, round_even(sum("Size_KB"::decimal(20, 2))::double / 1024, 2), (count(*) filter ("Has_Ajax_Calls" = 'Yes'))::double]) as "Value" from inv
union all select unnest([""" + ", ".join(f"'{m}'" for m in I.METRICS) + "]), unnest([" + ", ".join(f'sum("{m}")::double' for m in I.METRICS) + "]) from inv")
def complexity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.complexity_totals(_inventory(spark, sf_dir))


@query(METRICS_SQL + 'select "Extension", count(*) as "File_Count" from inv group by 1')
def extension_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.extension_breakdown(_inventory(spark, sf_dir))


@query(METRICS_SQL + """select count(*) as total_files, count(distinct "Directory") as total_dirs, sum("Line_Count")::bigint as total_lines, round(sum("Size_KB"::decimal(20, 2))::double / 1024, 6) as total_size_mb,
""" + ", ".join(f'sum("{n}")::bigint as "{n}"' for n in ("Inline_CSS_Count", "Inline_JS_Count", "Internal_Style_Blocks_Count", "Internal_Script_Blocks_Count", "External_Stylesheet_Links_Count", "External_Script_Tags_Count")) + """,
(select count(*) from details where "Is_Counted" = 'Yes') as ajax_calls from inv""")
def scan_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.written(_metrics(spark, sf_dir).drop("content"), "metrics")
    return I.scan_footer(I.inventory(m), I.ajax_detail_rows(m))


@query(METRICS_SQL + 'select "Directory", count(*) as files, sum("Inline_JS_Count")::bigint as js, sum("Inline_CSS_Count")::bigint as css, sum("AJAX_Calls_Count")::bigint as ajax from inv group by 1')
def folder_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.folder_progress(_inventory(spark, sf_dir))


@query(METRICS_SQL + 'select "Directory" as "Folder_Path", "Filename", "Extension", "Line_Count", "Size_KB", "Full_Path" from inv')
def file_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.file_details(_inventory(spark, sf_dir))


@query(METRICS_SQL + 'select "Full_Path", "Filename", ' + ", ".join(f'"{m}"' for m in I.METRICS) + ', "Has_Ajax_Calls" from inv')
def complexity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.complexity_metrics(_inventory(spark, sf_dir))


@query(FILES_SQL + f"""select path, extension, size_bytes from files where {O.in_list('extension', P.INCLUDE_EXTENSIONS)} and not list_has_any(string_split(directory, '/'), [{', '.join(map(O.q, P.STATIC_EXCLUDED_FOLDERS))}]) and size_bytes <= {10 * 1024 * 1024}""")
def select_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = paths.filter_excluded_folders(paths.filter_include_extensions(corpus(spark, sf_dir)))
    return paths.filter_max_size(files).select("path", "extension", "size_bytes")


@query(FILES_SQL + f"""select path, not list_has_any(string_split(directory, '/'), [{', '.join(map(O.q, P.DEPTH_EXCLUDED_FOLDERS))}]) as kept, {O.in_list('extension', P.WEB_EXTENSIONS)} as is_web, 'http://localhost/' || rel_path as target_url from files""")
def file_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir)
    kept = paths.filter_excluded_folders(files, P.DEPTH_EXCLUDED_FOLDERS).select("page_id", F.lit(True).alias("k"))
    return files.join(kept, "page_id", "left").select("path", F.coalesce("k", F.lit(False)).alias("kept"), paths.is_web_file(F.col("extension")).alias("is_web"), paths.target_url(F.col("rel_path")).alias("target_url"))


# --- findings ------------------------------------------------------------------------------------------------------

_F = "file_path, finding_no, start_line, end_line, category, code_type, source_type, snippet, full_code"


@query(BLOCKS_SQL + f"select {_F} from f")
def block_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.block_findings(corpus(spark, sf_dir)).select(*_F.split(", "))


_SCORES = ("file_path", "finding_no", "dynamic_code_detected", "dynamic_count", "dynamic_pattern", "logic_density_score", "complexity", "server_severity", "functionality", "refactor_status", "recommended_method", "target_filename", "bundled_file")


@query(BLOCKS_SQL + f"select {', '.join(_SCORES)} from f")
def finding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select(*_SCORES)


_AJAX = ("file_path", "finding_no", "ajax_detected", "ajax_count", "ajax_pattern", "capability", "difficulty", "endpoint_url", "has_server_deps", "is_inline_ajax")


@query(BLOCKS_SQL + f"select {', '.join(_AJAX)} from f")
def ajax_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select(*_AJAX)


_CALLS_SQL = """(select d.file_path as "File_Path", regexp_extract(d.rel_path, '[^/]*$') as "File_Name", finding_no, match_no, category as "Category", capability as "Capability", is_counted as "Is_Valid_Call", line as "Start_Line", end_line as "End_Line", endpoint as "Endpoint",
case when h then 'Yes' else 'No' end as "Has_Server_Dependencies", 'Yes' as "Is_Inline", 'No' as "Is_Internal", 'No' as "Is_External", code_snippet as "Code_Snippet" from d join (select file_path, finding_no, has_server_deps as h from f) using (file_path, finding_no))"""


@query(BLOCKS_SQL + f'select row_number() over (order by "File_Path", finding_no, match_no) as "Row_No", * from {_CALLS_SQL}')
def ajax_code_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.add_row_ids(D.ajax_code_report(_blocks(spark, sf_dir)), ["File_Path", "finding_no", "match_no"], name="Row_No")


@query(BLOCKS_SQL + f"""select "Endpoint", count(*) as calls, count(distinct "File_Path") as files, case when {O.in_list('"Endpoint"', P.UNKNOWN_ENDPOINTS)} then 'Yes' else 'No' end as is_dynamic from {_CALLS_SQL} where "Is_Valid_Call" = 'Yes' group by 1""")
def endpoint_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.endpoint_inventory(D.ajax_code_report(_blocks(spark, sf_dir)))


@query(BLOCKS_SQL + "select 0::bigint as inline_js, count(*) filter (category = 'JS') as internal_js, 0::bigint as external_js, 0::bigint as inline_css, count(*) filter (category = 'CSS') as internal_css, 0::bigint as external_css, count(*) as total from f")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.findings_summary(_blocks(spark, sf_dir))


@query(BLOCKS_SQL + """select sum(ajax_count)::bigint as ajax_total, coalesce(sum(ajax_count) filter (is_inline_ajax), 0)::bigint as ajax_inline, coalesce(sum(ajax_count) filter (ajax_detected and not is_inline_ajax), 0)::bigint as ajax_external, coalesce(sum(ajax_count) filter (has_server_deps), 0)::bigint as ajax_server_deps,
coalesce(sum(ajax_count) filter (is_inline_ajax and not has_server_deps), 0)::bigint as ajax_clean, sum(dynamic_count)::bigint as dynamic_total from f""")
def ajax_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ajax_totals(_blocks(spark, sf_dir))


@query(BLOCKS_SQL + """select count(*) as total, count(*) filter (server_severity not in ('High', 'Medium') and complexity <> 'High') as ready, count(*) filter (server_severity = 'High') as blocked, count(*) filter (server_severity = 'Medium') as rewrite,
count(*) filter (server_severity not in ('High', 'Medium') and complexity = 'High') as manual_review, count(*) filter (category = 'JS') as js, count(*) filter (category = 'CSS') as css, count(*) filter (ajax_detected) as with_ajax from f""")
def refactoring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.refactoring_summary(_blocks(spark, sf_dir))


_TRACKER_SQL = """select '{0}-' || printf('%04d', row_number() over (order by file_path, finding_no)) as "Ref_ID", regexp_extract(rel_path, '[^/]*$') || ' : L' || start_line as "Location", code_type as "Code_Type", functionality as "Functionality", complexity as "Complexity", case when ajax_detected then 'Yes' else 'No' end as "AJAX",
refactor_status as "Extraction_Status", target_filename as "Target_Filename", recommended_method as "Recommended_Method", '' as "Dev_Notes" from f where category = '{0}'"""


@query(BLOCKS_SQL + _TRACKER_SQL.format("JS"))
def refactoring_tracker_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.refactoring_tracker(_blocks(spark, sf_dir), "JS")


@query(BLOCKS_SQL + _TRACKER_SQL.format("CSS"))
def refactoring_tracker_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.refactoring_tracker(_blocks(spark, sf_dir), "CSS")


@query(BLOCKS_SQL + "select category || '-' || finding_no as kind, file_path, finding_no, row_number() over (partition by category || '-' || finding_no order by file_path) as row_no from f")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.block_findings(corpus(spark, sf_dir)).select(F.concat_ws("-", "category", "finding_no").alias("kind"), "file_path", "finding_no")
    return T.add_row_ids(rows, ["file_path"], by="kind")


@query(BLOCKS_SQL + "select 'inline_' || lower(category) as folder, bundled_file as file_name, max_by(full_code, (file_path, finding_no)) as full_code from f where full_code <> '' group by 1, 2")
def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bundle(_blocks(spark, sf_dir))


@query(HTML_SQL + "select case when source_type = 'LOCAL' then 'internal_' else 'inline_' end || lower(category) as folder, bundled_file as file_name, max_by(full_code, (file_path, finding_no)) as full_code from f where category in ('JS', 'CSS') and full_code <> '' group by 1, 2")
def html_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bundle(_html(spark, sf_dir))


@query(BLOCKS_SQL + f"""select 'http://localhost/' || rel_path as "Target_URL", file_path as "Source_File", case when bool_or(ajax_detected) then 'Page Entry Point, Contains AJAX' else 'Page Entry Point' end as "Rationale", 'Check CSP' as "Interaction_Hints"
from f where {O.in_list("lower(regexp_extract(rel_path, '([.][^.]*)$', 1))", P.PAGE_EXTENSIONS)} group by file_path, rel_path""")
def crawler_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.crawler_input(_blocks(spark, sf_dir))


@query(BLOCKS_SQL + "select path, size_bytes from files where path in (select file_path from f where ajax_detected)")
def pages_with_ajax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pages_with_ajax(corpus(spark, sf_dir), _blocks(spark, sf_dir)).select("path", "size_bytes")


@query(BLOCKS_SQL + "select file_path as source_file, start_line, end_line, code_type, refactor_status as status, bundled_file as extracted_file from f where full_code <> '' and refactor_status in ('Ready', 'Skipped (Rewrite)')")
def extract_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.extract_ready(_blocks(spark, sf_dir))


@query(BLOCKS_SQL + "select split_part(rel_path, '/', 1) as module, category, count(*) as findings, count(distinct file_path) as files, sum(ajax_count)::bigint as ajax_calls from f group by 1, 2")
def findings_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.findings_by_module(_blocks(spark, sf_dir))


_FOUND = ("file_path", "rel_path", "finding_no", "start_line", "end_line", "category", "code_type", "source_type", "snippet", "full_code", "html_context")


@query(HTML_SQL + f"select {', '.join(_FOUND)} from f")
def html_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.extract_findings(corpus(spark, sf_dir))


@query(HTML_SQL + f"select {', '.join(_FOUND)} from f")
def html_findings_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_findings(D.extract_findings(corpus(spark, sf_dir)))


@query(HTML_SQL + f"select {', '.join(_SCORES)} from f")
def html_finding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html(spark, sf_dir).select(*_SCORES)


@query(HTML_SQL + f"select {', '.join(_AJAX)} from f")
def html_ajax_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html(spark, sf_dir).select(*_AJAX)


_STYLED = "(contains(lower(code_type), 'style') or contains(lower(code_type), 'css'))"
_OUTSIDE = "source_type in ('LOCAL', 'REMOTE')"
_KIND_SQL = {
    "inline_js": "category = 'JS' and source_type = 'INLINE' and code_type <> 'scriptblock'",
    "internal_js": "category = 'JS' and source_type = 'INLINE' and code_type = 'scriptblock'",
    "external_js": "(category = 'JS' and source_type = 'LOCAL' or category in ('Internal', 'External') and contains(lower(code_type), 'script'))",
    "inline_css": "category = 'CSS' and source_type = 'INLINE' and not contains(code_type, 'styleblock')",
    "internal_css": "category = 'CSS' and source_type = 'INLINE' and contains(code_type, 'styleblock')",
    "external_css": f"(category = 'CSS' and source_type = 'LOCAL' or category in ('Internal', 'External') and {_STYLED})",
}
_SUMMARY_SQL = _KIND_SQL | {
    "external_js": f"{_OUTSIDE} and (contains(lower(code_type), 'script') or category in ('JS', 'Internal', 'External')) and not {_STYLED}",
    "external_css": f"{_OUTSIDE} and ({_STYLED} or category = 'CSS')",
}


@query(HTML_SQL + f"select *, {' + '.join(_SUMMARY_SQL)} as total from (select {', '.join(f'count(*) filter ({t}) as {n}' for n, t in _SUMMARY_SQL.items())} from f)")
def html_findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.findings_summary(_html(spark, sf_dir))


_YES = "case when {0} then 'Yes' else 'No' end"
_REMOTE = _YES.format("source_type = 'REMOTE'")
_SLICE_SQL = {
    "inline_js": "code_type as \"Context\", start_line as \"Line\", snippet as \"Code_Snippet\", case when html_context <> '' then html_context else full_code end as \"Full_Code\"",
    "internal_js": f'bundled_file as "Extracted_File", start_line as "Line", end_line - start_line as "Length", {_YES.format("ajax_detected")} as "Contains_AJAX", snippet as "Code_Snippet", full_code as "Full_Code"',
    "external_js": f"code_type as \"Reference_Type\", case when category = 'JS' then 'Self' else snippet end as \"Source_URL\", case when category = 'JS' then {_YES.format('ajax_detected')} else 'N/A (Reference)' end as \"Contains_AJAX\", start_line as \"Line\", {_REMOTE} as \"Is_Remote\"",
    "inline_css": 'code_type as "Attribute", start_line as "Line", snippet as "Code_Snippet"',
    "internal_css": 'bundled_file as "Extracted_File", start_line as "Line", snippet as "Code_Snippet", full_code as "Full_Code"',
    "external_css": f"code_type as \"Reference_Type\", case when category = 'CSS' then 'Self' else snippet end as \"Source_URL\", start_line as \"Line\", {_REMOTE} as \"Is_Remote\"",
}


def _slice(f: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(_html(spark, sf_dir))

    name = f"slice_{f.__name__}"
    QUERIES[name] = run
    ORACLE_SQL[name] = HTML_SQL + f"""select file_path as "File_Path", regexp_extract(rel_path, '[^/]*$') as "File_Name", {_SLICE_SQL[f.__name__]} from f where {_KIND_SQL[f.__name__]}"""


for _f in (T.inline_js, T.internal_js, T.external_js, T.inline_css, T.internal_css, T.external_css):
    _slice(_f)

# --- crawl and correlation -----------------------------------------------------------------------------------------

#: The character references of the corpus.
_REFERENCES = (("&#x2F;", "/"), ("&#47;", "/"), ("&eacute;", "é"), ("&amp;", "&"))
_TAGS_SQL = FILES_SQL + f", {O.tags_sql('(select page_id as file_path, url as rel_path, content from files)')}"


def _values_sql(tag: str, attribute: str) -> str:
    """(url, value) of an attribute in all tags of that name, the last of repeated ones."""
    value = f"list_filter(ats, lambda x: x.k = '{attribute}')[-1].v"
    test = f"name = '{tag}' and value is not null" + (r" and list_contains(regexp_split_to_array(lower(list_filter(ats, lambda x: x.k = 'rel')[-1].v), '\s+'), 'stylesheet')" if tag == "link" else "")
    for name, char in _REFERENCES:
        value = f"replace({value}, '{name}', '{char}')"
    return f"(select rel_path as url, {value} as value from tk where {test})"


_LINKS_SQL = _TAGS_SQL + rf""", hrefs as (select distinct url, value as href from {_values_sql('a', 'href')}),
parts as (select *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as origin, regexp_extract(url, '^([^?#]*)', 1) as page from hrefs),
joined as (select url, origin, href, split_part(case when regexp_matches(href, '^[a-z]+:') then href when starts_with(href, '/') then origin || href
  when starts_with(href, '../') then regexp_replace(case when regexp_matches(page, '^[a-z]+://[^/]+/[^/]+/') then regexp_replace(page, '/[^/]*/[^/]*$', '/') else origin || '/' end, '/*$', '/') || href[4:] else regexp_replace(page, '[^/]*$', '') || href end, '#', 1) as dst from parts),
links as (select distinct url as src_url, dst as dst_url from joined where regexp_extract(dst, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) = split_part(origin, '://', 2) and not regexp_matches(lower(dst), '(?:{'|'.join(e.replace('.', '[.]') for e in P.SKIP_LINK_EXTENSIONS)})$'))
"""


@query(_LINKS_SQL + "select * from links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.page_links(_pages(spark, sf_dir))


@query(_TAGS_SQL + rf""", s as (select url, value as src from {_values_sql('script', 'src')}),
t as (select url, case when starts_with(src, '/') then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || src else src end as target from s)
select url, 'html' as type from files union select target, 'js' from t where regexp_extract(target, '//([^/?#]*)', 1) = regexp_extract(url, '//([^/?#]*)', 1)""")
def discover_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.discover_assets(_pages(spark, sf_dir))


_EXTERNAL_SQL = f"""(select source_page, url, type from (select url as source_page, value as url, 'Script' as type from {_values_sql('script', 'src')}
union all select url, value, 'Stylesheet' from {_values_sql('link', 'href')}) where starts_with(url, 'https:'))"""


@query(_TAGS_SQL + f"select * from {_EXTERNAL_SQL}")
def external_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.external_assets(_pages(spark, sf_dir))


_REACH_SQL = "with recursive " + _LINKS_SQL.removeprefix("with ") + f""", sites as (select src_url as url, dst_url from links),
reach(url, depth) as (select distinct url, 0 from files union select s.dst_url, r.depth + 1 from reach r join sites s using (url) where r.depth < {P.MAX_DEPTH})
select url, min(depth)::int as depth from reach group by 1"""


@query(_REACH_SQL)
def crawl_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return W.crawl_reach(W.page_links(pages), pages.select("url"))


@query(_TAGS_SQL + f""", r as (select source_page as page, url as resource, type from {_EXTERNAL_SQL}), b as (select page, resource, type, 'Static' as m from r where type = 'Script' union all select page, resource, type, 'Dynamic' from r)
select page, resource, type, string_agg(distinct m, ', ' order by m) as detection_method, case when type = 'Stylesheet' then 'style-src' else 'script-src' end as csp_action from b group by 1, 2, 3""")
def resource_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.external_assets(_pages(spark, sf_dir)).select(F.col("source_page").alias("page"), F.col("url").alias("resource"), "type")
    return W.resource_origins(rows.filter("type = 'Script'"), rows)


@query(f"with {corpus_sql()}, {O.html_sql('(select url as path, url as rel_path, content from files)')} select file_path, finding_no, snippet, ajax_pattern, endpoint_url, ajax_count from f where ajax_detected")
def dynamic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dynamic_findings(corpus(spark, sf_dir).select("page_id", "url", "content")).select("file_path", "finding_no", "snippet", "ajax_pattern", "endpoint_url", "ajax_count")


def _static_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.filter_excluded_folders(paths.filter_include_extensions(corpus(spark, sf_dir)))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.static_index(D.block_findings(_static_files(spark, sf_dir)))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.static_keys(D.block_findings(_static_files(spark, sf_dir)))


def _dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with calls in the corpus taken as stored pages."""
    pages = corpus(spark, sf_dir).select(F.col("url").alias("path"), "rel_path", "content")
    return D.enrich_findings(D.block_findings(pages)).filter("ajax_detected").select(F.col("file_path").alias("url"), "snippet", "ajax_pattern", "endpoint_url")


_NORM = r"trim(regexp_replace(snippet, '\s+', ' ', 'g'))"


def _corr_sql(ix: str) -> str:
    """The correlation (co) with the rows ``ix`` of snippets, made from the pages of their locations (ip)."""
    return BLOCKS_SQL + rf""", {O.tags_sql('(select page_id as file_path, url as rel_path, content from files)')}, sf as (select f.*, {_NORM} as norm from f join files on path = file_path where snippet <> '' and {O.in_list('extension', P.INCLUDE_EXTENSIONS)} and not list_has_any(string_split(directory, '/'), [{', '.join(map(O.q, P.STATIC_EXCLUDED_FOLDERS))}])),
ik as (select norm, file_path, finding_no, row_number() over (partition by norm order by file_path, finding_no) as k, count(*) over (partition by norm) as location_count from sf),
ip as (select norm, (k - 1) // {C.PAGE_LOCATIONS} + 1 as page, string_agg(file_path, ', ' order by k) as locations, location_count, (location_count + {C.PAGE_LOCATIONS - 1}) // {C.PAGE_LOCATIONS} as location_pages from ik group by norm, page, location_count),
ix as ({ix}),
dy as (select files.url, snippet, ajax_pattern, endpoint_url, {_NORM} as norm from f join files on path = file_path where ajax_detected),
co as (select case when ix.norm is null then 'NEW_WEB_ONLY' else 'VERIFIED' end as status, url as dynamic_url, ajax_pattern as ajax_type, endpoint_url, snippet, coalesce(locations, 'N/A') as locations, coalesce(location_count, 0) as location_count, coalesce(location_pages, 0) as location_pages from dy left join ix using (norm)
 union all select 'MISSING_IN_CRAWL', 'N/A', 'Unknown', 'N/A', norm[1:100] || '...', locations, location_count, location_pages from ix where norm not in (select norm from dy))
"""


_CORR_SQL = _corr_sql("select * from ip where page = 1")
#: The same with all locations of a snippet in its row.
_WHOLE_SQL = _corr_sql("select norm, string_agg(locations, ', ' order by page) as locations, location_count, location_pages from ip group by norm, location_count, location_pages")


@query(_CORR_SQL + "select norm, page, locations, location_count from ip")
def static_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.array_join(F.transform("locations", lambda x: x["file"]), ", ")
    return _index(spark, sf_dir).select("norm", "page", files.alias("locations"), "location_count")


@query(_WHOLE_SQL + "select * from co")
def correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.hold_long_lists(spark)
    return C.correlate(T.written(_index(spark, sf_dir), "index"), T.written(_dynamic(spark, sf_dir), "dynamic"), whole=True)


@query(_CORR_SQL + "select md5(norm) as h, file_path as file, finding_no as row from sf")
def static_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.static_locations(D.block_findings(_static_files(spark, sf_dir)))


@query(_CORR_SQL + """, kx as (select norm, min(file_path) as first_file, count(*) as n from sf group by 1)
select case when n is null then 'NEW_WEB_ONLY' else 'VERIFIED' end as status, url as dynamic_url, ajax_pattern as ajax_type, endpoint_url, snippet, md5(norm) as h, first_file, coalesce(n, 0) as location_count from dy left join kx using (norm)
union all select 'MISSING_IN_CRAWL', 'N/A', 'Unknown', 'N/A', norm[1:100] || '...', md5(norm), first_file, n from kx where norm not in (select norm from dy)""")
def correlate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.correlate_keys(T.written(_keys(spark, sf_dir), "keys"), T.written(_dynamic(spark, sf_dir), "dynamic"))


@query(_WHOLE_SQL + "select * from co where status = 'MISSING_IN_CRAWL'")
def missing_in_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_in_crawl(T.written(_index(spark, sf_dir), "index"), _dynamic(spark, sf_dir), whole=True)


@query(_CORR_SQL + "select url, snippet, ajax_pattern, endpoint_url from dy where norm not in (select norm from ix)")
def web_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.web_only(_index(spark, sf_dir), _dynamic(spark, sf_dir))


_DOMAIN = O.csp_domain_sql("endpoint_url")


@query(_CORR_SQL + f"""select domain, count(*) as frequency, string_agg(distinct s, ', ' order by s) as source_status, 'connect-src' as directive from (select {_DOMAIN} as domain, case when status = 'VERIFIED' then 'Verified' else 'New' end as s from co where status <> 'MISSING_IN_CRAWL') where not {O.in_list('domain', P.NOT_DOMAINS)} group by 1""")
def csp_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.csp_allowlist(C.correlated_keys_table(_keys(spark, sf_dir), _dynamic(spark, sf_dir)))


@query(_WHOLE_SQL + f"""select status, ajax_type, endpoint_url as endpoint, case when status = 'MISSING_IN_CRAWL' then 'N/A' else {_DOMAIN} end as csp_domain, dynamic_url as web_url, locations as static_files, location_count, location_pages, snippet[1:500] as code_snippet from co""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.hold_long_lists(spark)
    return C.correlation_matrix(C.correlate(T.written(_index(spark, sf_dir), "index"), T.written(_dynamic(spark, sf_dir), "dynamic"), whole=True))


@query(_CORR_SQL + f"""select unnest(['Verified (Found in both)', 'New / Web Only (Dynamic)', 'Missing in Crawl (Unvisited/Dead)', 'Total AJAX Patterns Tracked']) as label, unnest([count(*) filter (status = 'VERIFIED'), count(*) filter (status = 'NEW_WEB_ONLY'), count(*) filter (status = 'MISSING_IN_CRAWL'), count(*)]) as n from co
union all select 'External Resources Found', count(*) from {_EXTERNAL_SQL}""")
def correlation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.correlation_summary(C.correlated_keys_table(_keys(spark, sf_dir), _dynamic(spark, sf_dir)), W.external_assets(_pages(spark, sf_dir)))


# --- refactoring ---------------------------------------------------------------------------------------------------

_NAME = "translate(rel_path, '/', '_') || '_' || regexp_replace(code_type, '[^A-Za-z0-9]', '', 'g') || '_line' || start_line || '-' || end_line || case when category = 'JS' then '.js' else '.css' end"
_TOKENS = "list_concat(list_concat(list_concat(list_concat(list_concat(list_concat({0}), {1}), {2}), {3}), {4}), {5})"


_KIND = "case when code_type in ('scriptblock', 'styleblock') or source_type = 'LOCAL' then 'internal' else 'inline' end"


def _assess_sql(base: str) -> str:
    toks = "flatten([" + ", ".join(f"regexp_extract_all(content, {O.q(p)})" for p in P.RAZOR_VALUES) + "])"
    return base + rf""", x as (select {_NAME} as filename, {_KIND} as category, full_code as content, rel_path, start_line, end_line, code_type, category = 'CSS' as css from f where category in ('JS', 'CSS') and full_code <> ''),
x1 as (select *, case when regexp_matches(content, {O.any_of(P.RAZOR_CONTROL)}) then 'C' when regexp_matches(content, {O.q('(?:' + '|'.join(P.RAZOR_VALUES) + ')')}) then 'B' else 'A' end as raw, {toks} as toks, not css and regexp_matches(content, {O.any_of(P.SIMPLE_AJAX)}) as aj from x),
x2 as (select *, css and raw = 'B' and len(list_filter(toks, lambda t: contains(t, '@') and contains(t, '('))) > 0 as hard, case when raw = 'B' then len(toks) else 0 end as n from x1),
x3 as (select *, case when hard then 'C' else raw end as state from x2),
assessed as (select filename, translate(translate(rel_path, '/', '_'), '_', '/') as original_file, start_line || '-' || end_line as lines, regexp_replace(code_type, '[^A-Za-z0-9]', '', 'g') as code_type, category, state, case state when 'A' then 'High' when 'B' then 'Medium' else 'Low' end as complexity, case state when 'A' then 'Ready' when 'B' then 'Bridgeable' else 'Blocked' end as status,
 case state when 'A' then case when css then 'Externalized - Clean CSS' else 'Externalized - Clean Code' end when 'B' then 'Auto-Refactor via Bridge' else 'Manual Intervention Required' end as action,
 case when hard then 'CSS contains complex Razor logic' when css and state = 'B' then 'CSS contains simple Razor URL references' when css and state = 'C' then 'CSS contains Razor control flow' when state = 'A' then 'No server-side logic detected'
  when state = 'B' and aj then 'AJAX call with ' || n || ' Razor tokens - Bridge Pattern applicable' when state = 'B' then 'Contains ' || n || ' Razor value tokens - Bridge Pattern applicable' else 'Contains Razor control flow - cannot auto-refactor' end as reason,
 n as razor_tokens, case when aj then 'Yes' else 'No' end as ajax, trim(replace(content[1:150], chr(10), ' ')) as snippet from x3)
"""


@query(_assess_sql(BLOCKS_SQL) + "select * from assessed")
def assessment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assessment_rows(R.extracted_blocks(_blocks(spark, sf_dir)))


@query(_assess_sql(HTML_SQL) + "select * from assessed")
def html_assessment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assessment_rows(R.extracted_blocks(_html(spark, sf_dir)))


_INDEX_SQL = """select *, round((clean + bridge + 0.8 * inline) / total * 100, 2)::double as refactorability from
(select count(*) as total, count(*) filter (state = 'A') as clean, count(*) filter (state = 'B') as bridge, count(*) filter (category = 'inline' and state in ('A', 'B')) as inline from assessed)"""


@query(_assess_sql(BLOCKS_SQL) + _INDEX_SQL)
def refactorability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.refactorability_index(R.assessment_rows(R.extracted_blocks(_blocks(spark, sf_dir))))


@query(_assess_sql(HTML_SQL) + _INDEX_SQL)
def html_refactorability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.refactorability_index(R.assessment_rows(R.extracted_blocks(_html(spark, sf_dir))))


@query(BLOCKS_SQL + """, b as (select distinct translate(rel_path, '/', '_') as whole from f where full_code <> ''), bp as (select distinct unnest([whole, 'project_' || whole, whole[6:]]) as block_path from b),
n as (select rel_path, translate(rel_path, '/', '_') as name from files), e as (select block_path, min(rel_path) as rel_path from bp join n on block_path = name group by 1),
s as (select block_path, count(*) as c, min(rel_path) as rel_path from bp join n on ends_with(name, block_path) or ends_with(block_path, name) where block_path not in (select block_path from e) group by 1)
select block_path, coalesce(e.rel_path, s.rel_path) as rel_path from bp left join e using (block_path) left join (select * from s where c = 1) s using (block_path)""")
def resolve_original_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir)
    whole = R.sanitized(F.col("rel_path"))
    blocks = D.block_findings(files).filter("full_code <> ''").select(F.explode(F.array(whole, F.concat(F.lit("project_"), whole), F.substring(whole, 6, 1 << 20))).alias("block_path"))
    return R.resolve_original_file(blocks, files)


@query(BLOCKS_SQL + r"""select file_path, finding_no, start_line, code_type, a as action, null::varchar as element_id, file as new_file, '<script src="' || file || '"></script>' as replacement, case when a = 'bridge' then full_code end as code from
(select *, case when a = 'bridge' then '/js/internal/' || regexp_extract(rel_path, '[^/]*$') || '_script_' || md5(full_code)[1:8] || '.js' end as file from (select *, case when not contains(full_code, '@') then 'leave' when regexp_matches(full_code, '@if|@foreach|@for|@while') then 'todo' else 'bridge' end as a from f where category = 'JS'))""")
def refactor_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.refactor_plan(_blocks(spark, sf_dir))


_MARK = "md5(full_code)[1:8]"
_ELEMENT = rf"""coalesce(nullif(regexp_extract(html_context, '\sid="([^"]*)"', 1), ''), 'ref-' || {_MARK})"""
_HANDLERS_SQL = f"""(select file_path, finding_no, start_line, code_type, 'listener' as action, {_ELEMENT} as element_id, '/js/inline/' || regexp_extract(rel_path, '[^/]*$') || '_' || code_type || '_' || {_MARK} || '.js' as new_file,
'document.addEventListener(''DOMContentLoaded'', function () {{ var el = document.getElementById(''' || {_ELEMENT} || '''); if (el) {{ el.addEventListener(''' || code_type[3:] || ''', function (event) {{ ' || full_code || ' }}); }} }});' as code from f where category = 'JS' and {O.in_list("code_type", P.REFACTORED_EVENTS)})"""


@query(HTML_SQL + f"""select *, '<script src="' || new_file || '"></script>' as replacement from {_HANDLERS_SQL}""")
def refactor_plan_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.refactor_plan(_html(spark, sf_dir)).filter("action = 'listener'")


@query(HTML_SQL + f"""select file_path, string_agg(new_file, ', ' order by finding_no) as scripts, count(*) as n_scripts from {_HANDLERS_SQL} group by 1""")
def bottom_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bottom_scripts(R.refactor_plan(_html(spark, sf_dir)))


_RECOUNT = {"inline_css": (P.INLINE_CSS, "Inline_CSS_Count"), "internal_style_blocks": (P.INTERNAL_STYLE, "Internal_Style_Blocks_Count"), "inline_js": (P.INLINE_JS, "Inline_JS_Count"), "internal_script_blocks": (P.INTERNAL_SCRIPT, "Internal_Script_Blocks_Count"), "ajax_calls": (r"(?:\bfetch\s*\(|new\s+XMLHttpRequest\s*\(|\$\.ajax\s*\(|\$\.get\s*\(|\$\.post\s*\()", "AJAX_Calls_Count")}
_MANUAL_SQL = ", ".join(
    f"({'sum(len(list_filter(regexp_extract_all(content, ' + O.rx(P.ANY_SCRIPT) + '), lambda x: not regexp_matches(x, ' + O.rx(P.SCRIPT_WITH_SRC) + '))))' if n == 'internal_script_blocks' else 'sum(' + O.n_of('content', p) + ')'})::bigint" for n, (p, _) in _RECOUNT.items()
)


@query(METRICS_SQL + f""", r as (select unnest([{', '.join(f"'{n}'" for n in _RECOUNT)}]) as metric, unnest([{', '.join(f'sum("{c}")::bigint' for _, c in _RECOUNT.values())}]) as report_count from inv),
m as (select unnest([{', '.join(f"'{n}'" for n in _RECOUNT)}]) as metric, unnest([{_MANUAL_SQL}]) as manual_count from files where {O.in_list('extension', P.RECOUNT_EXTENSIONS)})
select metric, report_count, manual_count, manual_count - report_count as difference from r join m using (metric)""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = _inventory(spark, sf_dir)
    report = inv.agg(*(F.sum(c).alias(n) for n, (_, c) in _RECOUNT.items()))
    files = corpus(spark, sf_dir).filter(F.col("extension").isin(*P.RECOUNT_EXTENSIONS))
    return T.reconcile(report, files.agg(*(F.sum(ajax.count(F.col("content"), p)).alias(n) for n, (p, _) in _RECOUNT.items())))


@query(BLOCKS_SQL + f"select distinct endpoint as endpoint_url, {O.csp_domain_sql('endpoint')} as domain from d")
def csp_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = D.ajax_code_report(_blocks(spark, sf_dir)).select(F.col("Endpoint").alias("endpoint_url")).distinct()
    return calls.select("endpoint_url", paths.csp_domain(F.col("endpoint_url")).alias("domain"))


@query(f"""with {corpus_sql()}, b as (select regexp_extract(rel_path, '[^/]*$') || '_scriptblock_line' || page_id || '-' || (page_id + 9) || '.js' as filename from files)
select filename, translate(regexp_extract(filename, '^(.+)_([a-zA-Z0-9]+)_line', 1), '_', '/') as original_path, regexp_extract(filename, '_line([0-9-]+)', 1) as line_range, 'scriptblock' as code_type, regexp_extract(filename, '_line([0-9]+)', 1)::bigint as start_line, regexp_extract(filename, '-([0-9]+)[.]js$', 1)::bigint as end_line from b""")
def extracted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("filename", F.lit("_scriptblock_line"), F.col("page_id").cast("string"), F.lit("-"), (F.col("page_id") + 9).cast("string"), F.lit(".js"))
    return corpus(spark, sf_dir).select(name.alias("filename")).select("filename", scoring.parse_extracted_filename(F.col("filename")).alias("p")).select("filename", "p.*")


@query("select url as file_path, 'html' as type, coalesce(html, '') as content from pages")
def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import read_pages

    return read_pages(spark, f"{sf_dir}/pages.parquet").select("file_path", "type", "content")


_ASCII = r"regexp_replace(substr(coalesce(html, ''), 1, 400), '[^\x20-\x7E\r\n]', '', 'g')"


@query(rf"""with a as (select page_id, html, {_ASCII} as a, page_id % 4 as k from pages),
d as (select page_id, case k when 0 then html when 1 then '“é' || a || '”' when 2 then chr(129) || a when 3 then a end as content, case when k = 0 and html is null then null else ['utf-8', 'windows-1252', 'latin-1', 'utf-16'][k + 1] end as encoding from a)
select page_id, regexp_replace(content, '\r\n?', chr(10), 'g') as content, encoding from d""")
def decoded_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes of four kinds by turns, decoded again."""
    from ..sources.files import decode_content

    ascii_ = F.regexp_replace(F.substring(F.coalesce("html", F.lit("")), 1, 400), r"[^\x20-\x7E\r\n]", "")
    byte = lambda x: F.unhex(F.lit(x))
    kind, own = F.col("page_id") % 4, F.encode(ascii_, "US-ASCII")
    raw = F.when(kind == 0, F.encode("html", "UTF-8")).when(kind == 1, F.concat(byte("93E9"), own, byte("94"))).when(kind == 2, F.concat(byte("81"), own)).otherwise(F.concat(byte("FFFE"), F.encode(ascii_, "UTF-16LE")))
    return decode_content(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", raw.alias("bytes")))


@query("select max_by('report-' || user_id || '-' || event_id, (ts, 'report-' || user_id || '-' || event_id)) as path from events")
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import latest_report as latest

    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return latest(rows.select(F.concat(F.lit("report-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("modified")))
