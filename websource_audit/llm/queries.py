"""One query per corpus operator, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, hard_negatives, jaccard_join, license_scan, packing, quality, secret_scan, simhash, suffix_dedup, tiff, token_counts, warc
from .common import read_table, stash


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = secret_scan.scan_documents(docs)
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(r.kind) for r in secret_scan.BASE_RULES),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(read_table(spark, sf_dir, "pages"))
    records = stash(warc.read_archives(spark, folder), "records")
    return warc.resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limit_answers(token_counts.length_histogram(read_table(spark, sf_dir, "documents")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(read_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    files = tiff.texts_to_tiff(docs)
    pages = tiff.tiff_pages(files.withColumn("id", F.struct("id", "n_bytes")), "id", "media")
    out = tiff.page_features(pages.select(F.col("id.id").alias("id"), F.col("id.n_bytes").alias("n_bytes"), "media_bytes", "media_sha256", "samples", "error"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")


def _license_rows(found: DataFrame) -> DataFrame:
    starts = F.transform("places", lambda p: p["start"])
    labels = lambda *xs: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(x, lambda y: y["label"]) for x in xs)))), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(F.col("places")).alias("base_labels"),
        labels(F.col("places"), F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks are lines, as in the SQL."""
    return _license_rows(license_scan.scan_licenses(read_table(spark, sf_dir, "documents")))


def op7_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks are paragraphs, so wrapped templates are met."""
    return _license_rows(license_scan.scan_licenses(read_table(spark, sf_dir, "documents"), paragraphs=True))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    found = quality.with_quality(docs, labels, F.col("source"), F.col("lang"), keep_text=False)
    return found.select("doc.doc_id", "doc.source", "doc.lang", "log_odds", "host_share", "path_share", "quality", "keep")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_warc, op3_token_counts, op4_jaccard_join, op5_suffix_dedup, op6_tiff, op7_license_scan, op7_license_paragraphs, op8_quality, op9_best_fit, op10_decontamination, op11_collocations, op12_hard_negatives, op13_simhash)}

_WORDS = r"list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SHINGLES = "case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end"

def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """(start, rank, stop, kind) of the matches of one rule: a match begins where all pieces and matches before it end."""
    q = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{q}')) + 1), lambda i: {{'s': (list_sum(list_transform(string_split_regex(t, '{q}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{q}')[1:i - 1], lambda x: length(x))), 0))::bigint, 'r': {rank}, 'e': (list_sum(list_transform(string_split_regex(t, '{q}')[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(t, '{q}')[1:i], lambda x: length(x))))::bigint, 'k': '{kind}', 'n': length(regexp_extract_all(t, '{q}', {group})[i])}}), lambda x: x.n >= {least})"""


def _secret_sql() -> str:
    rules = list(enumerate(secret_scan.RULES))
    text = lambda xs: f"array_to_string(list_transform({xs}, lambda x: concat(x.k, ':', x.s, ':', x.e)), ',')"
    each = ", ".join(f"case when regexp_matches(t, '{r.gate.replace(chr(39), chr(39) * 2)}') then {_spans_sql(r.kind, k, r.pattern, r.group, r.least)} else [] end as a{k}" for k, r in rules)
    base = len(secret_scan.BASE_RULES)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), f as (select doc_id, {each} from d),
g as (select doc_id, list_sort(flatten([{', '.join(f'a{k}' for k, _ in rules)}])) as xs from f)
select doc_id, {', '.join(f"len(list_filter(xs, lambda x: x.k = '{r.kind}')) as n_{r.kind}" for r in secret_scan.BASE_RULES)},
sha256({text(f'list_filter(xs, lambda x: x.r < {base})')}) as base_sha256, {text('xs')} as spans from g
"""


def _license_sql() -> str:
    words = lambda t: rf"list_filter(string_split_regex(translate({t}, '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.GAPS}'), lambda x: x <> '')"
    sql_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    places = ", ".join(
        f"list_transform(list_filter(range(1, len(w) - {len(p.split()) - 2}), lambda i: w[i:i + {len(p.split()) - 1}] = {sql_list(p.split())}), lambda i: {{'s': i - 1, 'l': '{label}'}})"
        for p, label in license_scan.BASE_PHRASES
    )
    sets = [(label, license_scan.template_tokens(t)) for label, t in license_scan.TEMPLATES]
    found = ", ".join(f"case when len(list_intersect(b, {sql_list(ts)})) >= {license_scan.need(len(ts))} then {{'l': '{label}', 'c': len(list_intersect(b, {sql_list(ts)})) / {len(ts)}}} end" for label, ts in sets)
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents), w as (select doc_id, t, {words('t')} as w from d),
p as (select doc_id, len(w) as n_words, flatten([{places}]) as ps, list_transform(string_split(t, chr(10)), lambda y: {words('y')}) as bs from w),
m as (select *, list_filter(flatten(list_transform(bs, lambda b: [{found}])), lambda x: x is not null) as ms from p)
select doc_id, n_words, len(ps) as n_base, list_min(list_transform(ps, lambda x: x.s)) as first_word, list_max(list_transform(ps, lambda x: x.s)) as last_word,
array_to_string(list_sort(list_distinct(list_transform(ps, lambda x: x.l))), ',') as base_labels,
array_to_string(list_sort(list_distinct(list_concat(list_transform(ps, lambda x: x.l), list_transform(ms, lambda x: x.l)))), ',') as labels,
coalesce(list_max(list_transform(ms, lambda x: x.c)), 0.0)::double as score from m
"""


ORACLE_SQL: dict[str, str] = {
    "op11_collocations": r"""
with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from t),
g as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3), (4)) ks(k) where len(w) >= k),
f as materialized (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
c as materialized (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k >= 2 and f >= 30),
u as (select *, unnest(range(1, k)) as j from c),
x as (select u.lang, u.k, u.phrase, u.w, u.a, j, p.f as l, q.f as r, ((2000000::hugeint * a) // (p.f + q.f))::bigint as score
  from u join f p on p.lang = u.lang and p.phrase = array_to_string(u.w[1:j], ' ') join f q on q.lang = u.lang and q.phrase = array_to_string(u.w[j + 1:], ' ')),
b as (select * from x qualify row_number() over (partition by lang, phrase order by score, j) = 1),
i as (select lang, a, w, m, unnest(range(1, len(w) - m + 2)) as s from (select *, unnest(range(2, k)) as m from c)),
d as (select lang, array_to_string(w[s:s + m - 1], ' ') as phrase, max(a) as longer from i group by all),
o as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank from b left join d on d.lang = b.lang and d.phrase = b.phrase where longer is null or 100 * longer < 80 * a)
select o.lang, rank, phrase, a, l, r, n, score from o join n using (lang) where rank <= 2000
""",
    "op12_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank, id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, id) <= 10
""",
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as h, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') as url from pages),
r as (select *, case when strlen(h) >= 100 then min(page_id) over (partition by h) else page_id end as head from p)
select page_id, strlen(h) as payload_bytes, sha256(h) as payload_digest, case when head <> page_id then 'revisit' else 'response' end as record_type,
case when head <> page_id then head end as refers_to, url from r
""",
    "op4_jaccard_join": f"""
with recursive d as (select doc_id, {_WORDS} as w from documents), s as materialized (select distinct doc_id, unnest({_SHINGLES}) as s from d),
n as materialized (select d.doc_id, count(s.s) as n from d left join s using (doc_id) group by 1),
o as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as materialized (select x, y from o join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
r(doc_id, root) as (select doc_id, doc_id from n union select e.x, r.root from r join e on e.y = r.doc_id)
select n.doc_id, n.n as n_shingles, min(r.root) as component_id from n join r using (doc_id) group by 1, 2
""",
    "op7_license_scan": _license_sql(),
    "op1_secret_scan": _secret_sql(),
    "op10_decontamination": f"""
with d as (select doc_id, {_WORDS} as w from documents), i as (select item_id, {_WORDS} as w from benchmark),
ds as (select distinct doc_id, unnest({_SHINGLES}) as s from d), bs as (select distinct item_id, unnest({_SHINGLES}) as s from i),
n as (select item_id, count(*) as n_item from bs group by 1),
hit as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by 1, 2)
select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from hit join n using (item_id) where 100 * n_shared >= 80 * n_item
""",
}
