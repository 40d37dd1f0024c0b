"""Columns of file names, paths and urls."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P

NO_EXTENSION = "(No Extension)"
ROOT = "(Root)"


def extension(name: Column, empty: str = NO_EXTENSION) -> Column:
    """Lower-case text from the last dot; leading dots start a name, not an extension."""
    found = F.lower(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1))
    return F.when(found == "", F.lit(empty)).otherwise(found)


def filename(rel_path: Column) -> Column:
    return F.substring_index(rel_path, "/", -1)


def directory(rel_path: Column) -> Column:
    """The folder of a path relative to the root; the root itself is "(Root)"."""
    return F.when(F.instr(rel_path, "/") == 0, F.lit(ROOT)).otherwise(F.regexp_replace(rel_path, r"/[^/]*$", ""))


def directory_depth(folder: Column) -> Column:
    """0 at the root, else the number of components."""
    return F.when(folder == ROOT, F.lit(0)).otherwise(F.size(F.split(folder, "/"))).cast("int")


def size_kb(size_bytes: Column) -> Column:
    """Rounded to two places, halves to even."""
    return F.bround(size_bytes / F.lit(1024), 2)


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a file-name glob of *, ? and [...]."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[k + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            k = end
        else:
            out += re.sub(r"([.^$+(){}\[\]|\\])", r"\\\1", c)
        k += 1
    return f"(?s)^{out}$"


def filter_include_extensions(df: DataFrame, exts: tuple[str, ...] = P.INCLUDE_EXTENSIONS) -> DataFrame:
    return df.filter(extension(F.col("filename"), "").isin(*exts))


def filter_excluded_folders(df: DataFrame, folders: tuple[str, ...] = P.STATIC_EXCLUDED_FOLDERS) -> DataFrame:
    """Drop files below a folder of just such a name; case counts, and file names don't."""
    return df.filter(~F.arrays_overlap(F.split("directory", "/"), F.array(*map(F.lit, folders)))) if folders else df


def filter_exclude_globs(df: DataFrame, globs: tuple[str, ...] = ()) -> DataFrame:
    for g in globs:
        df = df.filter(~F.col("filename").rlike(glob_regex(g)))
    return df


def filter_max_size(df: DataFrame, mb: float = 10) -> DataFrame:
    return df.filter(F.col("size_bytes") <= mb * 1024 * 1024)


def is_web_file(ext: Column) -> Column:
    return ext.isin(*P.WEB_EXTENSIONS)


def line_count(content: Column, size_bytes: Column) -> Column:
    """Line feeds plus one; in large files lines are read, so a final line feed starts no other line."""
    n = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    return F.when((size_bytes > P.LARGE_FILE_BYTES) & content.endswith("\n"), n - 1).otherwise(n).cast("long")


def netloc(url: Column) -> Column:
    """Host and port of a url, empty if it has none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def is_internal(url: Column, base: Column) -> Column:
    return netloc(url) == netloc(base)


def skip_binary_links(df: DataFrame, url_col: str) -> DataFrame:
    ends = "|".join(re.escape(e) for e in P.SKIP_LINK_EXTENSIONS)
    return df.filter(~F.lower(F.col(url_col)).rlike(f"(?:{ends})$"))


def target_url(rel_path: Column) -> Column:
    return F.concat(F.lit("http://localhost/"), F.translate(rel_path, "\\", "/"))


@F.pandas_udf(StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b: str, h: str) -> str | None:
        try:
            return urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([None if b is None or h is None else one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def resolve_url(base: Column, href: Column) -> Column:
    """The link's url as a browser resolves it, without fragment: plain forms natively, relative paths by a helper.

    Absolute links keep their text, ``//host`` takes the scheme, ``/path`` scheme and host of the base; dots in a path and
    all other links go to the helper.
    """
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    dots = href.rlike(r"/\.{1,2}(?:[/?#]|$)")
    web = F.lower(scheme).isin("http:", "https:")
    whole = (
        F.when(href.rlike(r"^[a-z][a-z0-9+.-]*://[^/?#]+/[^?#\s;]*[^\s?#]*$") & ~dots & F.lower(href).rlike("^https?:"), href)
        .when(href.rlike(r"^//[^/?#\s]+/[^?#\s;]+$") & ~dots & web, F.concat(scheme, href))
        .when(href.rlike(r"^/[^/?#\s;][^?#\s;]*$") & ~dots & web, F.concat(origin, href))
        .otherwise(_joined(base, href))
    )
    return F.substring_index(whole, "#", 1)


def csp_domain(endpoint: Column) -> Column:
    """The domain to allow for an endpoint, or why there is none."""
    e = F.coalesce(endpoint, F.lit(""))
    host = netloc(e)
    return (
        F.when((e == "") | e.isin(*P.UNKNOWN_ENDPOINTS), F.lit("Manual Review Required"))
        .when(e.startswith("/"), F.lit("Self"))
        .when(host != "", host)
        .when(e.contains(".") & e.contains("/"), F.substring_index(e, "/", 1))
        .otherwise(F.lit("Self (Assumed)"))
    )


def normalize_snippet(code: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(code, r"(?U)\s+", " "))


