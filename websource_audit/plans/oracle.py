"""DuckDB SQL for the audit queries, built from the same rule texts as the Spark side."""

from __future__ import annotations

from ..functions import ajax
from ..functions import patterns as P
from ..operators.inventory import COUNTS, METRICS
from ..sources.corpus import corpus_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return q(P.DUCK + pattern)


def feeds(xs: str) -> str:
    return f"coalesce(list_sum(list_transform({xs}, lambda x: length(x) - length(replace(x, chr(10), '')))), 0)"


def any_of(patterns: tuple[str, ...]) -> str:
    return rx("(?:" + "|".join(patterns) + ")")


def n_of(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {rx(pattern)}))"


def in_list(column: str, values: tuple[str, ...]) -> str:
    return f"{column} in ({', '.join(map(q, values))})"


def contains_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def with_matches(source: str, text: str, pattern: str, extra: str = "*") -> str:
    """Rows of ``source`` with i, line and m for each match of the pattern."""
    p = rx(pattern)
    return f"""(select * exclude (ms, ps), ms[i] as m, (1 + {feeds('ps[1:i]')} + {feeds('ms[1:i - 1]')})::bigint as line from
(select *, unnest(range(1, len(ms) + 1)) as i from (select {extra}, regexp_extract_all({text}, {p}) as ms, string_split_regex({text}, {p}) as ps from {source})))"""


SCANNED = f"{in_list('extension', P.WEB_EXTENSIONS)} and size_bytes <= {P.LARGE_FILE_BYTES}"


def metrics_sql() -> str:
    counts = []
    for name, (pattern, _) in COUNTS.items():
        if name == "Internal_Script_Blocks_Count":
            n = f"len(list_filter(regexp_extract_all(content, {rx(P.ANY_SCRIPT)}), lambda x: not regexp_matches(x, {rx(P.SCRIPT_WITH_SRC)})))"
        else:
            n = n_of("content", pattern)
        counts.append(f'case when {SCANNED} then {n} else 0 end as "{name}"')
    calls = f"len(list_filter(regexp_extract_all(content, {rx(P.AJAX)}), lambda x: {ajax.classify_sql('x', 2)} = 'Yes'))"
    counts.append(f'case when {SCANNED} then {calls} else 0 end as "AJAX_Calls_Count"')
    counts.append(f'case when {SCANNED} then {n_of("content", P.DYNAMIC_JS)} else 0 end as "Dynamic_JS_Gen_Count"')
    counts.append(f'case when {SCANNED} then {n_of("content", P.DYNAMIC_CSS)} + {n_of("content", P.CSS_IN_JS)} else 0 end as "Dynamic_CSS_Gen_Count"')
    return f"""with {corpus_sql()},
counted as materialized (select *, length(content) - length(replace(content, chr(10), '')) + 1 as "Line_Count", round_even(size_bytes / 1024, 2) as "Size_KB", {', '.join(counts)} from files),
inv as (select directory as "Directory", filename as "Filename", extension as "Extension", "Size_KB", "Line_Count", {', '.join(f'"{m}"' for m in METRICS)}, case when "AJAX_Calls_Count" > 0 then 'Yes' else 'No' end as "Has_Ajax_Calls", path as "Full_Path" from counted),
details as (select path as "File_Path", filename as "Filename", (i - 1)::bigint as "Match_No", line as "Line", m[1:100] as "Code_Snippet", {ajax.classify_sql('m', 1)} as "Category", {ajax.classify_sql('m', 0)} as "Capability", {ajax.classify_sql('m', 3)} as "Difficulty", {ajax.classify_sql('m', 2)} as "Is_Counted"
  from {with_matches('files', 'content', P.AJAX)} where {SCANNED})
"""


def endpoint_sql(code: str, match: str) -> str:
    head = f"{code}[1:1000]"
    got = lambda p: f"nullif(regexp_extract({head}, {rx(p)}, 1), '')"
    literal = got(P.URL_PROPERTY)
    return f"""coalesce(case when contains({match}, 'fetch') then coalesce({got(P.FETCH_TEMPLATE)}, {got(P.FETCH_LITERAL)})
 when contains({match}, 'jquery') or contains({match}, '$') then {got(P.JQUERY_LITERAL)} when contains({match}, 'axios') then {got(P.AXIOS_LITERAL)} end,
 {got(P.URL_TEMPLATE)}, case when contains({literal}, '@') or contains({literal}, '<%') then 'Server-Generated' else {literal} end, {got(P.URL_CONCAT)},
 case when {got(P.URL_VARIABLE)} is not null then 'Dynamic/Variable' end, 'Unknown/Dynamic')"""


def blocks_sql(source: str = "files") -> str:
    """Script and style blocks of files, scored: a chain of expressions that ends in f (findings) and d (their calls)."""
    strip = rf"regexp_replace(regexp_replace(m, '(?is)^<[^>]*>\s*', ''), '(?is)\s*</[a-z]+>$', '')"
    return f"""
js as (select path as file_path, rel_path, i, line, m, 'JS' as category, 'scriptblock' as code_type from {with_matches(source, 'content', P.ANY_SCRIPT, 'path, rel_path, content')} where not regexp_matches(m, {rx(P.SCRIPT_WITH_SRC)})),
css as (select path as file_path, rel_path, i, line, m, 'CSS' as category, 'styleblock' as code_type from {with_matches(source, 'content', P.INTERNAL_STYLE, 'path, rel_path, content')}),
bl as (select file_path, rel_path, line as start_line, category, code_type, {strip} as full_code, (row_number() over (partition by file_path order by category desc, i) - 1)::bigint as finding_no from (select * from js union all select * from css)),
bf as materialized (select *, (start_line + length(full_code) - length(replace(full_code, chr(10), '')))::bigint as end_line, 'INLINE' as source_type, full_code[1:200] as snippet from bl where category = 'CSS' or full_code <> ''),
{scored_sql()}"""


#: The inside of a tag: quoted parts, in which ">" is text, and what is not quoted.
INSIDE = r"""(?:"[^"]*"|'[^']*'|[^>"'])*"""
_ATTRIBUTE = r"""([^\s/>"'=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']?[^\s>]*))?"""


def stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def tags_sql(source: str) -> str:
    """Chain that ends in tk: each opening tag of ``source`` (file_path, rel_path, content) in order, with its attributes and, of scripts and styles, the text."""
    token = rf"(?s)<!--.*?-->|<script\b{INSIDE}>.*?(?:</script\s*>|\z)|<style\b{INSIDE}>.*?(?:</style\s*>|\z)|<[a-z]{INSIDE}>"
    tag, text = rx(f"(?s)^<[a-z]{INSIDE}>"), rx(rf"(?s)^<[a-z]{INSIDE}>(.*?)(?:</(?:script|style)\s*>)?$")
    return rf"""
t0 as (select *, lower(regexp_extract(m, '^<([A-Za-z][^\s/>]*)', 1)) as name, regexp_extract(m, {tag}) as tag from {with_matches(source, 'content', token, 'file_path, rel_path, content')} where not starts_with(m, '<!')),
t1 as (select *, tag[length(name) + 2:length(tag) - 1] as inside, regexp_extract(m, {text}, 1) as text from t0),
t2 as (select *, regexp_extract_all(inside, {rx(_ATTRIBUTE)}, 1) as ks, regexp_extract_all(inside, {rx(_ATTRIBUTE)}, 2) as vs from t1),
t3 as (select *, list_transform(range(1, len(ks) + 1), lambda j: {{'k': lower(ks[j]), 'v': case when regexp_matches(vs[j], '^["'']') then vs[j][2:length(vs[j]) - 1] else coalesce(vs[j], '') end}}) as ats from t2),
tk as materialized (select file_path, rel_path, i, line, name, text, ats, '<' || name || ' ' || array_to_string(list_transform(ats, lambda x: x.k || '="' || replace(x.v, '"', '&quot;') || '"'), ' ') || '>' as ctx from t3)"""


def html_sql(source: str = "files") -> str:
    """The findings of a tokenizer, here by patterns and lists, scored: ends in f and d as blocks_sql does."""
    of = lambda k: f"list_filter(ats, lambda x: x.k = '{k}')"
    lines = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')))"
    whole = "file_path, rel_path"

    def reference(order: int, attribute: str, what: str, test: str) -> str:
        url = f"{of(attribute)}[-1].v"
        either = lambda a, b: f"case when regexp_matches(lower({url}), '^(?:http:|https:|//)') then '{a}' else '{b}' end"
        return f"""select {whole}, {order} as o, i, 0 as j, 0 as u, line as start_line, line as end_line, {either('External', 'Internal')} as category, {either('External ' + what, 'Internal ' + what)} as code_type,
 {either('REMOTE', 'LOCAL')} as source_type, {url} as snippet, ctx as full_code, ctx as html_context from tk where {test}"""

    def block(order: int, sub: int, test: str, category: str, kind: str, where: str = "INLINE", long: int = 200) -> str:
        code = stripped("text")
        return f"select {whole}, {order}, i, 0, {sub}, line, line + {lines(code)}, '{category}', '{kind}', '{where}', ({code})[1:{long}], {code}, '' from tk where {test}"

    sheet = rf"list_contains(regexp_split_to_array(coalesce({of('rel')}[-1].v, ''), '\s+'), 'stylesheet')"
    return rf"""
src as materialized (select path as file_path, rel_path, content, regexp_matches(lower(path), '[^/.][.]js$') as plain from {source}), {tags_sql('(select * from src where not plain)')},
av as (select {whole}, i, line, ctx, j, ats[j].k as k, ats[j].v as v from (select *, unnest(range(1, len(ats) + 1)) as j from tk)),
ln as (select {whole}, unnest(range(1, len(string_split(content, chr(10))) + 1)) as i, unnest(string_split(content, chr(10))) as x from src),
al as ({reference(1, 'src', 'Script', f"name = 'script' and len({of('src')}) > 0")}
 union all {block(1, 0, f"name = 'script' and len({of('src')}) = 0 and text <> ''", 'JS', 'scriptblock')}
 union all select {whole}, 0, i, 0, 0, i, i, 'JS', 'jsuri', 'INLINE', {stripped('x')}, {stripped('x')}, '' from ln where regexp_matches(x, '(?i)href=["'']\s*javascript:')
 union all select {whole}, 1, 0, 0, 0, 1, len(string_split(content, chr(10))), 'JS', 'standalone_js', 'LOCAL', ({stripped('content')})[1:200], {stripped('content')}, '' from src where plain
 union all select {whole}, 2, i, j, 0, line, line + {lines('v')}, 'JS', k, 'INLINE', k || '="' || v || '"', v, ctx from av where {in_list('k', P.EVENT_HANDLERS)}
 union all select {whole}, 2, i, j, 1, line, line + {lines('v')}, 'JS', 'jsuri', 'INLINE', v, v, ctx from av where k in ('href', 'src') and starts_with({stripped('lower(v)')}, 'javascript:')
 union all {block(3, 0, "name = 'style' and contains(text, '@import')", 'External', 'External Style (@import)', 'REMOTE', 100)}
 union all {block(3, 1, "name = 'style'", 'CSS', 'styleblock')}
 union all select {whole}, 4, i, j, 0, line, line + {lines('v')}, 'CSS', case when contains(v, '<%') then 'ASP.NET Style' else 'inlinestyle' end, 'INLINE', 'style="' || v || '"', v, '' from av where k = 'style'
 union all {reference(5, 'href', 'Style', f"name = 'link' and len({of('href')}) > 0 and {sheet}")}),
bf as materialized (select *, (row_number() over (partition by file_path order by o, i, j, u) - 1)::bigint as finding_no from (select * replace (start_line::bigint as start_line, end_line::bigint as end_line) from al
 qualify row_number() over (partition by file_path, start_line, code_type, {stripped('full_code')} order by o, i, j, u) = 1)),
{scored_sql()}"""


def scored_sql() -> str:
    """What follows findings bf: their calls d, and f with all scores."""
    low = "lower(full_code)"
    score = f"2 * {n_of(low, P.LOGIC)} + (case when ajax_detected then 1 else 0 end) + {n_of(low, P.LISTENERS)}"
    dyn = " + ".join(f"dy{k}" for k in range(len(P.DYNAMIC_GROUPS)))
    counts = ", ".join(f"case when category = 'JS' then {n_of('full_code', p)} else 0 end as dy{k}" for k, (_, p) in enumerate(P.DYNAMIC_GROUPS))
    first = "case " + " ".join(f"when dy{k} > 0 then '{name}'" for k, (name, _) in enumerate(P.DYNAMIC_GROUPS)) + " else '' end"
    work = "case when ajax_detected then 'Data/Network Operation' " + " ".join(f"when {contains_any(low, words)} then '{name}'" for name, words in P.FUNCTIONALITY) + " else 'General Logic' end"
    name = lambda path, gap: rf"{path} || '_' || regexp_replace(code_type, '[^\pL\pN]', '{gap}', 'g') || '_L' || start_line || '-L' || end_line || case when category = 'JS' then '.js' else '.css' end"
    scripts = with_matches("(select * from bf where category = 'JS')", "full_code", P.AJAX, "file_path, rel_path, finding_no, start_line, end_line, source_type, full_code")
    return f"""d as materialized (select file_path, rel_path, finding_no, end_line, source_type, full_code, (i - 1)::bigint as match_no, (start_line + line - 1)::bigint as line, m[1:100] as code_snippet, {ajax.classify_sql('m', 1, 'static')} as category, {ajax.classify_sql('m', 0, 'static')} as capability, {ajax.classify_sql('m', 3, 'static')} as difficulty, {ajax.classify_sql('m', 2, 'static')} as is_counted, {endpoint_sql('full_code', 'm')} as endpoint
  from {scripts}),
g as (select file_path as fp, finding_no as fn, count(*) as n, count(*) filter (is_counted = 'Yes') as ajax_count, min_by(category || ' (' || capability || ')', match_no) as ajax_pattern, min_by(capability, match_no) as capability, min_by(difficulty, match_no) as difficulty, min_by(endpoint, match_no) as endpoint_url from d group by 1, 2),
f0 as (select bf.*, g.n is not null as ajax_detected, coalesce(g.ajax_count, 0) as ajax_count, coalesce(g.ajax_pattern, '') as ajax_pattern, coalesce(g.capability, '') as capability, coalesce(g.difficulty, '') as difficulty, coalesce(g.endpoint_url, '') as endpoint_url, {counts} from bf left join g on file_path = fp and finding_no = fn),
f1 as (select *, {score} as s0, ({dyn})::bigint as dynamic_count, {dyn} > 0 as dynamic_code_detected, {first} as dynamic_pattern, ajax_detected and regexp_matches(full_code, {any_of(P.SERVER_DEPENDENCIES)}) as has_server_deps, ajax_detected and not ends_with(lower(file_path), '.js') as is_inline_ajax,
  case when regexp_matches(full_code, {rx(P.SEVERITY_HIGH)}) then 'High' when regexp_matches(full_code, {rx(P.SEVERITY_MEDIUM)}) then 'Medium' when regexp_matches(full_code, {rx(P.SEVERITY_LOW)}) then 'Low' else 'None' end as server_severity, {work} as functionality from f0),
f2 as (select *, (case when {n_of(low, P.SELECTORS)} > 0 and s0 < 2 then s0 - 2 else s0 end)::bigint as logic_density_score from f1),
f3 as (select *, case when logic_density_score >= 5 then 'High' when logic_density_score >= 2 then 'Medium' else 'Low' end as complexity from f2),
f as materialized (select *, case when server_severity = 'High' then 'Skipped (Blocked)' when server_severity = 'Medium' then 'Skipped (Rewrite)' when complexity = 'High' then 'Manual Review' else 'Ready' end as refactor_status,
  case when server_severity = 'High' then 'Remove Server Dependencies First' when server_severity = 'Medium' then 'Refactor Server Config (API)' when complexity = 'High' then 'Convert to Component (Complex Logic)' else 'Move to separate file' end as recommended_method,
  {name("translate(rel_path, '/.', '__')", '')} as target_filename, case when category in ('JS', 'CSS') and full_code <> '' then {name("translate(replace(rel_path, ':', ''), '/.', '__')", '_')} else '' end as bundled_file from f3)
"""


def csp_domain_sql(e: str) -> str:
    host = f"regexp_extract({e}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
    return f"case when coalesce({e}, '') = '' or {in_list(e, P.UNKNOWN_ENDPOINTS)} then 'Manual Review Required' when starts_with({e}, '/') then 'Self' when {host} <> '' then {host} when contains({e}, '.') and contains({e}, '/') then split_part({e}, '/', 1) else 'Self (Assumed)' end"
