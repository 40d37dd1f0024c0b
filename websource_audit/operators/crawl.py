"""Links and assets of stored pages, and the pages reachable from seeds."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import patterns as P
from ..functions import paths
from ..sources.shared import written

# the inside of a tag by parts: what is quoted, where ">" is text, and what is not; possessive, so that long tags need no stack
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: Tags that link to something, and what has to be passed over whole to find them: comments, and the text of scripts and styles.
LINKING = rf"(?is)<!--.*?-->|<(script|style)(?=[\s/>]){_INSIDE}>.*?(?:</\1\s*>|\z)|<(?:a|link)(?=[\s/>]){_INSIDE}>"
OPENING = rf"(?is)^<([a-z]+)({_INSIDE})>"
ATTRIBUTE = r"""([^\s/>"'=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']?[^\s>]*+))?"""
#: Character references resolved by plain replacement; texts with others go to the helper.
COMMON = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=])))")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    """Character references of attribute values; a name without semicolon is none before a letter, digit or equals sign."""
    return texts.map(lambda t: None if t is None else _REFERENCE.sub(lambda m: html.unescape(m[0]), t))


def unescaped(text: Column) -> Column:
    """All character references in attribute values. Only texts with an uncommon one reach the helper."""
    plain, rest = text, text
    for name, char in COMMON:
        plain, rest = F.replace(plain, F.lit(name), F.lit(char)), F.replace(rest, F.lit(name), F.lit(""))
    odd = rest.rlike("&[#A-Za-z]")
    return F.when(odd, _unescape(F.when(odd, text))).otherwise(plain)


def linking_tags(pages: DataFrame) -> DataFrame:
    """(url, name, inside) of the opening tags of anchors, links and scripts in pages (url, content)."""
    tags = pages.select("url", F.explode(F.regexp_extract_all("content", F.lit(LINKING), F.lit(0))).alias("tag")).filter(~F.col("tag").startswith("<!"))
    return tags.select("url", F.lower(F.regexp_extract("tag", OPENING, 1)).alias("name"), F.regexp_extract("tag", OPENING, 2).alias("inside"))


def attribute(inside: Column, name: str) -> Column:
    """The raw value of an attribute of an opening tag, of repeated ones the last; empty without a value, null without the attribute."""
    names, values = (F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2))
    own = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: F.lower(x["k"]) == name)
    value = F.get(own, F.size(own) - 1)["v"]
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def _values(pages: DataFrame, tag: str, name: str, out: str) -> DataFrame:
    """(url, ``out``) of all values that an attribute has in pages, repeats included."""
    rows = linking_tags(pages).filter(F.col("name") == tag).select("url", attribute(F.col("inside"), name).alias(out)).filter(F.col(out).isNotNull())
    return rows.withColumn(out, unescaped(F.col(out)))


def raw_links(pages: DataFrame) -> DataFrame:
    """(url, href) of all anchors in pages (url, content), repeats included."""
    return _values(pages, "a", "href", "href")


def _resolved(rows: DataFrame, ref: str) -> DataFrame:
    """Add target: each (url, reference) is resolved once, however often it occurs."""
    once = rows.select("url", ref).distinct().withColumn("target", paths.resolve_url(F.col("url"), F.col(ref)))
    return rows.join(once, ["url", ref])


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct (src_url, dst_url) links to pages of the same host that are worth a visit."""
    once = raw_links(pages).distinct().withColumn("dst_url", paths.resolve_url(F.col("url"), F.col("href")))
    inner = once.filter(paths.is_internal(F.col("dst_url"), F.col("url")))
    return paths.skip_binary_links(inner, "dst_url").select(F.col("url").alias("src_url"), "dst_url").distinct()


def script_sources(pages: DataFrame) -> DataFrame:
    """(url, target) of scripts with a source, repeats included."""
    return _resolved(_values(pages, "script", "src", "src"), "src").select("url", "target")


def stylesheet_links(pages: DataFrame) -> DataFrame:
    """(url, target) of stylesheet links, repeats included."""
    tags = linking_tags(pages).filter("name = 'link'").select("url", attribute(F.col("inside"), "href").alias("href"), F.lower(attribute(F.col("inside"), "rel")).alias("rel"))
    sheets = tags.filter((F.col("href") != "") & F.array_contains(F.split("rel", r"\s+"), "stylesheet"))
    return _resolved(sheets.select("url", unescaped(F.col("href")).alias("href")), "href").select("url", "target")


def discover_assets(pages: DataFrame) -> DataFrame:
    """Distinct (url, type): the pages themselves and the scripts of their own host."""
    own = script_sources(pages).filter(paths.is_internal(F.col("target"), F.col("url")))
    return pages.select("url", F.lit("html").alias("type")).unionByName(own.select(F.col("target").alias("url"), F.lit("js").alias("type"))).distinct()


def external_assets(pages: DataFrame) -> DataFrame:
    """Scripts and stylesheets of other hosts with the page that names them, repeats included."""
    outside = ~paths.is_internal(F.col("target"), F.col("url"))
    made = [d.filter(outside).select(F.col("url").alias("source_page"), F.col("target").alias("url"), F.lit(kind).alias("type")) for d, kind in ((script_sources(pages), "Script"), (stylesheet_links(pages), "Stylesheet"))]
    return made[0].unionByName(made[1])


def crawl_reach(links: DataFrame, seeds: DataFrame, max_depth: int = P.MAX_DEPTH) -> DataFrame:
    """(url, depth): what is reachable from ``seeds`` (url) in at most ``max_depth`` links, at its shortest distance.

    Each round joins the newest pages with their links and drops what was seen before; it is written, so no round repeats
    the ones before it.
    """
    seen = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "reach")
    edge = written(links.select(F.col("src_url").alias("url"), "dst_url").distinct(), "links")
    newest = seen
    for depth in range(1, max_depth + 1):
        step = newest.join(edge, "url").select(F.col("dst_url").alias("url")).distinct()
        newest = written(step.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return seen


def resource_origins(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """External resources by page with how they were found: rows (page, resource, type) of both kinds, merged."""
    both = static.select("page", "resource", "type", F.lit("Static").alias("m")).unionByName(dynamic.select("page", "resource", "type", F.lit("Dynamic").alias("m")))
    action = F.when(F.col("type") == "Stylesheet", "style-src").otherwise("script-src")
    return both.groupBy("page", "resource", "type").agg(F.array_join(F.array_sort(F.collect_set("m")), ", ").alias("detection_method")).withColumn("csp_action", action)
