"""Report tables of findings: slices, summaries, trackers, numbered rows and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import patterns as P
from ..sources.shared import written


def _yes(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def _file_columns() -> list[Column]:
    return [F.col("file_path").alias("File_Path"), paths.filename(F.col("rel_path")).alias("File_Name")]


def _is(kind: str) -> Column:
    """Which findings a slice takes."""
    js, css = F.col("category") == "JS", F.col("category") == "CSS"
    inline, local = F.col("source_type") == "INLINE", F.col("source_type") == "LOCAL"
    low = F.lower("code_type")
    reference = F.col("category").isin("Internal", "External")
    styled = low.contains("style") | low.contains("css")
    return {
        "inline_js": js & inline & (F.col("code_type") != "scriptblock"),
        "internal_js": js & inline & (F.col("code_type") == "scriptblock"),
        "external_js": (js & local) | (reference & low.contains("script")),
        "inline_css": css & inline & ~F.col("code_type").contains("styleblock"),
        "internal_css": css & inline & F.col("code_type").contains("styleblock"),
        "external_css": (css & local) | (reference & styled),
    }[kind]


def inline_js(findings: DataFrame) -> DataFrame:
    """Full code is the opening tag where there is one."""
    code = F.when(F.col("html_context") != "", F.col("html_context")).otherwise(F.col("full_code"))
    return findings.filter(_is("inline_js")).select(*_file_columns(), F.col("code_type").alias("Context"), F.col("start_line").alias("Line"), F.col("snippet").alias("Code_Snippet"), code.alias("Full_Code"))


def internal_js(findings: DataFrame) -> DataFrame:
    return findings.filter(_is("internal_js")).select(*_file_columns(), F.col("bundled_file").alias("Extracted_File"), F.col("start_line").alias("Line"), (F.col("end_line") - F.col("start_line")).alias("Length"), _yes(F.col("ajax_detected")).alias("Contains_AJAX"), F.col("snippet").alias("Code_Snippet"), F.col("full_code").alias("Full_Code"))


def external_js(findings: DataFrame) -> DataFrame:
    own = F.col("category") == "JS"
    return findings.filter(_is("external_js")).select(
        *_file_columns(), F.col("code_type").alias("Reference_Type"), F.when(own, "Self").otherwise(F.col("snippet")).alias("Source_URL"), F.when(own, _yes(F.col("ajax_detected"))).otherwise("N/A (Reference)").alias("Contains_AJAX"), F.col("start_line").alias("Line"), _yes(F.col("source_type") == "REMOTE").alias("Is_Remote")
    )


def inline_css(findings: DataFrame) -> DataFrame:
    return findings.filter(_is("inline_css")).select(*_file_columns(), F.col("code_type").alias("Attribute"), F.col("start_line").alias("Line"), F.col("snippet").alias("Code_Snippet"))


def internal_css(findings: DataFrame) -> DataFrame:
    return findings.filter(_is("internal_css")).select(*_file_columns(), F.col("bundled_file").alias("Extracted_File"), F.col("start_line").alias("Line"), F.col("snippet").alias("Code_Snippet"), F.col("full_code").alias("Full_Code"))


def external_css(findings: DataFrame) -> DataFrame:
    return findings.filter(_is("external_css")).select(*_file_columns(), F.col("code_type").alias("Reference_Type"), F.when(F.col("category") == "CSS", "Self").otherwise(F.col("snippet")).alias("Source_URL"), F.col("start_line").alias("Line"), _yes(F.col("source_type") == "REMOTE").alias("Is_Remote"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts of the six kinds and their total, one row."""
    low = F.lower("code_type")
    outside = F.col("source_type").isin("LOCAL", "REMOTE")
    styled = low.contains("style") | low.contains("css")
    js = outside & (low.contains("script") | F.col("category").isin("JS", "Internal", "External")) & ~styled
    tests = {
        "inline_js": _is("inline_js"), "internal_js": _is("internal_js"), "external_js": js,
        "inline_css": _is("inline_css"), "internal_css": (F.col("category") == "CSS") & (F.col("source_type") == "INLINE") & (F.col("code_type") == "styleblock"), "external_css": outside & (styled | (F.col("category") == "CSS")),
    }
    out = findings.agg(*(F.count_if(t).alias(n) for n, t in tests.items()))
    return out.withColumn("total", sum((F.col(n) for n in list(tests)[1:]), F.col("inline_js")))


def ajax_totals(findings: DataFrame) -> DataFrame:
    """Counted calls in all, inline, in script files, with server dependencies and clean; dynamic code in all. One row."""
    found, inline, deps = F.col("ajax_detected"), F.col("is_inline_ajax"), F.col("has_server_deps")
    total = lambda test, name: F.coalesce(F.sum(F.when(test, F.col("ajax_count"))), F.lit(0)).alias(name)
    return findings.agg(
        F.coalesce(F.sum("ajax_count"), F.lit(0)).alias("ajax_total"), total(found & inline, "ajax_inline"), total(found & ~inline, "ajax_external"), total(found & deps, "ajax_server_deps"), total(found & inline & ~deps, "ajax_clean"),
        F.coalesce(F.sum("dynamic_count"), F.lit(0)).alias("dynamic_total"),
    )


def refactoring_summary(findings: DataFrame) -> DataFrame:
    """Over all findings: those to extract, blocked, to rewrite, to review; scripts, styles, and those with calls. One row."""
    s = F.col("server_severity")
    high = F.col("complexity") == "High"
    calm = ~s.isin("High", "Medium")
    return findings.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(calm & ~high).alias("ready"), F.count_if(s == "High").alias("blocked"), F.count_if(s == "Medium").alias("rewrite"), F.count_if(calm & high).alias("manual_review"),
        F.count_if(F.col("category") == "JS").alias("js"), F.count_if(F.col("category") == "CSS").alias("css"), F.count_if("ajax_detected").alias("with_ajax"),
    )


#: Most parts that rows are numbered in, and keys sampled for each bound between them. No result depends on either.
ROW_PARTS, SAMPLED_KEYS = 1000, 50


def _bounds(rows: DataFrame, keys: list[str], parts: int) -> list[tuple]:
    """At most ``parts`` - 1 keys that cut the rows into parts of about equal size, from a sample of bounded size."""
    share = parts * SAMPLED_KEYS / max(1, rows.count())
    sample = rows.select(*keys) if share >= 1 else rows.select(*keys).sample(share, seed=7)
    got = [tuple(r) for r in sample.orderBy(*keys).collect()]
    return list(dict.fromkeys(got[len(got) * k // parts] for k in range(1, parts))) if got else []


def add_row_ids(df: DataFrame, order: list[str], by: str | None = None, name: str = "row_no", parts: int | None = None) -> DataFrame:
    """Number the rows from 1 in the total order ``order``, within each ``by`` if given, without one task seeing all rows.

    The rows are written once, so that what made them runs once. Keys alone are read for the bounds of the parts and the rows in
    each; then rows move once, to the task of their part (and group), where they are numbered and shifted by the rows of the
    parts before. Nulls come first. Rows of equal keys get different numbers in any order.
    """
    key = [by] if by else []
    parts = parts or min(ROW_PARTS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = written(df, "unordered")
    keys = [*key, *order]
    kinds = [rows.schema[k].dataType for k in keys]
    bounds = [F.struct(*(F.lit(v).cast(t).alias(k) for v, t, k in zip(b, kinds, keys, strict=True))) for b in _bounds(rows, keys, parts)]
    own = F.struct(*keys)
    rows = rows.withColumn("_part", F.size(F.filter(F.array(*bounds), lambda b: b <= own)) if bounds else F.lit(0))
    counts = rows.groupBy("_part", *key).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select(F.col("_part").alias("_p"), *(F.col(k).alias("_by") for k in key), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    numbered = rows.withColumn("_own", F.row_number().over(W.partitionBy("_part", *key).orderBy(*order)))
    same = (F.col("_part") == F.col("_p")) & (F.col(by).eqNullSafe(F.col("_by")) if by else F.lit(True))
    return numbered.join(shift, same).withColumn(name, (F.col("_own") + F.col("_shift")).cast("long")).select(*df.columns, name)


def refactoring_tracker(findings: DataFrame, category: str) -> DataFrame:
    """The checklist of one category (JS or CSS) with reference ids by file, line and order."""
    rows = add_row_ids(findings.filter(F.col("category") == category), ["file_path", "finding_no"])
    return rows.select(
        F.concat(F.lit(f"{category}-"), F.format_string("%04d", "row_no")).alias("Ref_ID"), F.concat(paths.filename(F.col("rel_path")), F.lit(" : L"), F.col("start_line").cast("string")).alias("Location"), F.col("code_type").alias("Code_Type"), F.col("functionality").alias("Functionality"),
        F.col("complexity").alias("Complexity"), _yes(F.col("ajax_detected")).alias("AJAX"), F.col("refactor_status").alias("Extraction_Status"), F.col("target_filename").alias("Target_Filename"), F.col("recommended_method").alias("Recommended_Method"), F.lit("").alias("Dev_Notes"),
    )


def bundle(findings: DataFrame) -> DataFrame:
    """(folder, file_name, full_code) of scripts and styles with code; of equal names the last finding's code stays."""
    base = F.when(F.col("source_type") == "LOCAL", "internal_").otherwise("inline_")
    rows = findings.filter(F.col("category").isin("JS", "CSS") & (F.length("full_code") > 0))
    rows = rows.select(F.concat(base, F.lower("category")).alias("folder"), F.col("bundled_file").alias("file_name"), "full_code", F.struct("file_path", "finding_no").alias("o"))
    return rows.groupBy("folder", "file_name").agg(F.max_by("full_code", "o").alias("full_code"))


def crawler_input(findings: DataFrame) -> DataFrame:
    """Each page file with findings as an address to visit."""
    ext = paths.extension(paths.filename(F.col("rel_path")))
    pages = findings.filter(ext.isin(*P.PAGE_EXTENSIONS)).groupBy("file_path", "rel_path").agg(F.max("ajax_detected").alias("has"))
    return pages.select(paths.target_url(F.col("rel_path")).alias("Target_URL"), F.col("file_path").alias("Source_File"), F.when(F.col("has"), "Page Entry Point, Contains AJAX").otherwise("Page Entry Point").alias("Rationale"), F.lit("Check CSP").alias("Interaction_Hints"))


def pages_with_ajax(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files that have a finding with a network call."""
    return files.join(findings.filter("ajax_detected").select(F.col("file_path").alias("path")), "path", "left_semi")


def extract_ready(findings: DataFrame) -> DataFrame:
    """Manifest of the blocks to extract: ready ones and those to rewrite, with where they go."""
    rows = findings.filter(F.col("category").isin("JS", "CSS") & (F.length("full_code") > 0) & F.col("refactor_status").isin("Ready", "Skipped (Rewrite)"))
    return rows.select(F.col("file_path").alias("source_file"), "start_line", "end_line", "code_type", F.col("refactor_status").alias("status"), F.col("bundled_file").alias("extracted_file"))


def endpoint_inventory(calls: DataFrame) -> DataFrame:
    """Counted calls of an ajax_code_report by endpoint; those that aren't literal are marked."""
    rows = calls.filter("Is_Valid_Call = 'Yes'")
    return rows.groupBy("Endpoint").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("File_Path").alias("files")).withColumn("is_dynamic", _yes(F.col("Endpoint").isin(*P.UNKNOWN_ENDPOINTS)))


def findings_by_module(findings: DataFrame) -> DataFrame:
    """Findings by top folder and category."""
    module = F.when(F.instr("rel_path", "/") == 0, F.lit(paths.ROOT)).otherwise(F.substring_index("rel_path", "/", 1))
    return findings.groupBy(module.alias("module"), "category").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("file_path").alias("files"), F.coalesce(F.sum("ajax_count"), F.lit(0)).alias("ajax_calls"))


def reconcile(report: DataFrame, recount: DataFrame) -> DataFrame:
    """Two one-row tables of totals, metric by metric, with the difference of recount and report; a metric of one side only counts 0 on the other."""
    a = report.unpivot([], report.columns, "metric", "report_count")
    b = recount.unpivot([], recount.columns, "metric", "manual_count")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "metric", "full").select("metric", zero("report_count"), zero("manual_count"), (F.coalesce("manual_count", F.lit(0)) - F.coalesce("report_count", F.lit(0))).alias("difference"))
