"""Static findings against findings of stored pages, and what a content security policy has to allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import paths
from ..sources.shared import written
from .reports import add_row_ids

#: Locations of a snippet in one row of the index.
PAGE_LOCATIONS = 100
#: About so many dynamic rows share one copy of their snippet's list, so that those of a common snippet go to several tasks.
ROWS_OF_A_COPY = 500
LONG_LISTS = {"parquet.dictionary.page.size": str(16 << 20), "parquet.page.size.row.check.max": "100", "parquet.column.statistics.enabled#locations": "false", "parquet.column.statistics.enabled#static_files": "false"}


def _static_rows(findings: DataFrame) -> DataFrame:
    norm = paths.normalize_snippet(F.col("snippet"))
    inline = F.col("category").isin("JS", "CSS") & (F.col("source_type") == "INLINE") & (F.length("snippet") > 0)
    return findings.filter(inline).select(norm.alias("norm"), F.struct(F.col("file_path").alias("file"), F.col("finding_no").alias("row")).alias("at"))


def static_keys(findings: DataFrame) -> DataFrame:
    """(norm, first_file, location_count): static_index without its lists, so rows stay small however common a snippet is."""
    return _static_rows(findings).groupBy("norm").agg(F.min("at")["file"].alias("first_file"), F.count(F.lit(1)).alias("location_count"))


def static_locations(findings: DataFrame) -> DataFrame:
    """(h, file, row): the lists of static_index as rows; ``h`` is the MD5 of the normalized snippet."""
    return _static_rows(findings).select(F.md5("norm").alias("h"), "at.file", "at.row")


def static_index(findings: DataFrame, page_size: int = PAGE_LOCATIONS) -> DataFrame:
    """(norm, page, locations, location_count): inline scripts and styles by normalized snippet, with the (file, row) that hold it.

    Locations are in order, in pages of ``page_size`` from page 1 on, so a row is small however many files have a snippet.
    location_count is of all pages. ``row`` is the finding's number in its file. Rows without a snippet are left out.
    """
    rows = add_row_ids(_static_rows(findings).select("norm", "at.file", "at.row"), ["file", "row"], by="norm", name="no")
    paged = rows.groupBy("norm", F.floor((F.col("no") - 1) / page_size + 1).cast("long").alias("page")).agg(F.array_sort(F.collect_list(F.struct("file", "row"))).alias("locations"), F.max("no").alias("last"))
    counts = written(paged, "pages")
    return counts.join(counts.groupBy(F.col("norm").alias("n")).agg(F.max("last").alias("location_count")), F.col("norm") == F.col("n")).select("norm", "page", "locations", "location_count")


def _first_pages(index: DataFrame) -> DataFrame:
    """(h, norm, files, location_count, location_pages): one row per snippet, with the files of its first page."""
    first = index.filter("page = 1")
    size = F.size("locations")  # the first page is full if there is another
    pages = F.ceil(F.col("location_count") / size).cast("long")
    files = F.array_join(F.transform("locations", lambda x: x["file"]), ", ")
    return first.select(F.xxhash64("norm").alias("h"), "norm", files.alias("files"), "location_count", pages.alias("location_pages"))


def _all_pages(index: DataFrame) -> DataFrame:
    """The columns of _first_pages, with the files of all pages in order."""
    one = F.array_join(F.transform("locations", lambda x: x["file"]), ", ")
    held = F.array_sort(F.collect_list(F.struct("page", one.alias("files"))))
    rows = index.groupBy("norm").agg(held.alias("held"), F.max("location_count").alias("location_count"))
    files = F.array_join(F.transform("held", lambda x: x["files"]), ", ")
    return rows.select(F.xxhash64("norm").alias("h"), "norm", files.alias("files"), "location_count", F.size("held").cast("long").alias("location_pages"))


def _keyed(dynamic: DataFrame) -> DataFrame:
    return dynamic.withColumn("norm", paths.normalize_snippet(F.col("snippet"))).withColumn("h", F.xxhash64("norm"))


def correlate(index: DataFrame, dynamic: DataFrame, whole: bool = False) -> DataFrame:
    """VERIFIED and NEW_WEB_ONLY per dynamic row (url, snippet, ajax_pattern, endpoint_url), MISSING_IN_CRAWL per key never seen.

    ``whole``: a row carries the files of all locations of its snippet, so it grows with them. Otherwise it has those of the
    first page and how many pages and locations there are; the others are in the index. The lists meet the rows last, in
    tasks that have the rows of a copy one after another: nothing is shuffled, sorted or written once rows have them.
    """
    static = _all_pages(index) if whole else _first_pages(index)
    keyed = _keyed(dynamic)
    copies = keyed.groupBy("h", "norm").agg(F.ceil(F.count(F.lit(1)) / ROWS_OF_A_COPY).cast("int").alias("copies"))
    held = static.join(copies, ["h", "norm"]).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    dealt = keyed.withColumn("no", F.monotonically_increasing_id()).join(copies, ["h", "norm"], "left").withColumn("copy", (F.col("no") % F.coalesce("copies", F.lit(1)) + 1).cast("int")).drop("no", "copies")
    parts, key = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["h", "norm", "copy"]
    rows = dealt.repartition(parts, *key).join(held.repartition(parts, *key), key, "left")  # by number: Spark would join small parts to one task, whose rows then are large
    hit = F.col("files").isNotNull()
    none = F.lit(0).cast("long")
    found = rows.select(
        F.when(hit, "VERIFIED").otherwise("NEW_WEB_ONLY").alias("status"), F.col("url").alias("dynamic_url"), F.col("ajax_pattern").alias("ajax_type"), "endpoint_url", "snippet",
        F.when(hit, F.col("files")).otherwise("N/A").alias("locations"), F.coalesce("location_count", none).alias("location_count"), F.coalesce("location_pages", none).alias("location_pages"),
    )
    return found.unionByName(missing_in_crawl(index, dynamic, whole))


def missing_in_crawl(index: DataFrame, dynamic: DataFrame, whole: bool = False) -> DataFrame:
    """Static keys that no dynamic row has, in the columns of correlate."""
    seen = _keyed(dynamic).select("h", "norm").distinct()
    static = _all_pages(index) if whole else _first_pages(index)
    rows = static.join(seen, ["h", "norm"], "left_anti")
    return rows.select(F.lit("MISSING_IN_CRAWL").alias("status"), F.lit("N/A").alias("dynamic_url"), F.lit("Unknown").alias("ajax_type"), F.lit("N/A").alias("endpoint_url"), F.concat(F.substring("norm", 1, 100), F.lit("...")).alias("snippet"), F.col("files").alias("locations"), "location_count", "location_pages")


def correlate_keys(keys: DataFrame, dynamic: DataFrame) -> DataFrame:
    """correlate with the first file and the snippet's MD5 (h, as of static_locations) in place of locations, from static_keys."""
    static = keys.withColumn("h", F.xxhash64("norm"))
    rows = _keyed(dynamic).join(static, ["h", "norm"], "left")
    status = F.when(F.col("location_count").isNotNull(), "VERIFIED").otherwise("NEW_WEB_ONLY").alias("status")
    found = rows.select(status, F.col("url").alias("dynamic_url"), F.col("ajax_pattern").alias("ajax_type"), "endpoint_url", "snippet", F.md5("norm").alias("h"), "first_file", F.coalesce("location_count", F.lit(0)).alias("location_count"))
    unseen = static.join(_keyed(dynamic).select("h", "norm").distinct(), ["h", "norm"], "left_anti")
    missing = unseen.select(F.lit("MISSING_IN_CRAWL").alias("status"), F.lit("N/A").alias("dynamic_url"), F.lit("Unknown").alias("ajax_type"), F.lit("N/A").alias("endpoint_url"), F.concat(F.substring("norm", 1, 100), F.lit("...")).alias("snippet"), F.md5("norm").alias("h"), "first_file", "location_count")
    return found.unionByName(missing)


def web_only(index: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Dynamic rows whose snippet is in no source file."""
    return _keyed(dynamic).join(index.filter("page = 1").select("norm", F.xxhash64("norm").alias("h")), ["h", "norm"], "left_anti").drop("h", "norm")


def csp_allowlist(correlated: DataFrame) -> DataFrame:
    """Domains of verified and new rows with their frequency and status, sorted by domain."""
    rows = correlated.filter("status <> 'MISSING_IN_CRAWL'").select(paths.csp_domain(F.col("endpoint_url")).alias("domain"), F.when(F.col("status") == "VERIFIED", "Verified").otherwise("New").alias("s"))
    rows = rows.filter(~F.col("domain").isin(*P.NOT_DOMAINS))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("frequency"), F.array_join(F.array_sort(F.collect_set("s")), ", ").alias("source_status")).withColumn("directive", F.lit("connect-src")).orderBy("domain")


def correlation_matrix(correlated: DataFrame) -> DataFrame:
    """All rows with their domain and the files of their locations, snippets cut to 500 characters."""
    domain = F.when(F.col("status") == "MISSING_IN_CRAWL", "N/A").otherwise(paths.csp_domain(F.col("endpoint_url")))
    return correlated.select("status", "ajax_type", F.col("endpoint_url").alias("endpoint"), domain.alias("csp_domain"), F.col("dynamic_url").alias("web_url"), F.col("locations").alias("static_files"), "location_count", "location_pages", F.substring("snippet", 1, 500).alias("code_snippet"))


def correlation_summary(correlated: DataFrame, external: DataFrame) -> DataFrame:
    """(label, n): counts of each status, their total and the external resources."""
    s = F.col("status")
    one = correlated.agg(F.count_if(s == "VERIFIED").alias("Verified (Found in both)"), F.count_if(s == "NEW_WEB_ONLY").alias("New / Web Only (Dynamic)"), F.count_if(s == "MISSING_IN_CRAWL").alias("Missing in Crawl (Unvisited/Dead)"), F.count(F.lit(1)).alias("Total AJAX Patterns Tracked"))
    out = one.unpivot([], one.columns, "label", "n")
    return out.unionByName(external.agg(F.count(F.lit(1)).alias("n")).select(F.lit("External Resources Found").alias("label"), "n"))


def hold_long_lists(spark: SparkSession) -> None:
    """Let Parquet files written from here on keep a list of up to 16 MB once for all of its rows, and their writer look at its memory every 100 rows.

    By default lists beyond 1 MB are written once a row, and up to 10,000 rows are held before the writer looks. The columns of lists
    get no smallest and largest value, for which each list would be compared twice. Settings that the session has stay.
    """
    for name, value in LONG_LISTS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def correlated_keys_table(keys: DataFrame, dynamic: DataFrame) -> DataFrame:
    """correlate_keys, written once, for tables that need no locations."""
    return written(correlate_keys(keys, dynamic).select("status", "endpoint_url"), "correlated_keys")
