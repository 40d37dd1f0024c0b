"""Inventory: pattern counts of files, their network calls, and statistics by directory and extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ajax, paths
from ..functions import patterns as P

#: Count columns: pattern, and cheap tests one of which holds for whatever it matches: a text, or a plain pattern after "re:".
COUNTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "Inline_CSS_Count": (P.INLINE_CSS, ("style",)),
    "Internal_Style_Blocks_Count": (P.INTERNAL_STYLE, ("</style>",)),
    "External_Stylesheet_Links_Count": (P.EXTERNAL_STYLESHEET, ("stylesheet", "@import")),
    "Inline_JS_Count": (P.INLINE_JS, ("javascript:", r"re:\bon[^\s=]+\s*=")),
    "Internal_Script_Blocks_Count": (P.INTERNAL_SCRIPT, ("</script>",)),
    "External_Script_Tags_Count": (P.EXTERNAL_SCRIPT, ("src", "import", "require", "define")),
}
DYNAMIC_JS_NEEDLES = (".src", "document.", ".appendchild", ".insertbefore", "eval", "function", "settimeout", "setinterval", "import", "require", "innerhtml", "outerhtml", "insertadjacenthtml")
DYNAMIC_CSS_NEEDLES = (".src", "document.", ".rel", ".href", ".style", ".csstext", "setproperty", "insertrule", "addrule", "setattribute", ".classlist", "cssstylesheet", "adoptedstylesheets")
CSS_IN_JS_NEEDLES = ("styled", "css`")
METRICS = (*COUNTS, "AJAX_Calls_Count", "Dynamic_JS_Gen_Count", "Dynamic_CSS_Gen_Count")


def _gated(content: Column, pattern: str, needles: tuple[str, ...]) -> Column:
    def test(low: Column) -> Column:
        hit = low.contains(needles[0])
        for n in needles[1:]:
            hit = hit | (low.rlike(n[3:]) if n.startswith("re:") else low.contains(n))
        return hit

    return F.when(ajax.let(F.lower(content), test), ajax.count(content, pattern)).otherwise(0)


def file_metrics(files: DataFrame) -> DataFrame:
    """``files`` with Line_Count, Size_KB, all counts, Has_Ajax_Calls and the classified matches as array ajax_details.

    Patterns count in web files up to the size limit only, elsewhere they are 0. The matches are taken once: count
    and details both come from the array. All of it is a projection.
    """
    c = F.col("content")
    scanned = paths.is_web_file(F.col("extension")) & (F.col("size_bytes") <= P.LARGE_FILE_BYTES)
    out = files.withColumns(
        {
            "Line_Count": paths.line_count(c, F.col("size_bytes")),
            "Size_KB": paths.size_kb(F.col("size_bytes")),
            "ajax_details": F.when(scanned, ajax.details(c, F.lit(1), "depth", with_endpoint=False)).otherwise(F.array().cast(ajax.DETAILS)),
        }
    )
    counts = {name: F.when(scanned, _gated(c, p, needles)).otherwise(0).cast("long") for name, (p, needles) in COUNTS.items()}
    counts["AJAX_Calls_Count"] = ajax.counted(F.col("ajax_details"))
    counts["Dynamic_JS_Gen_Count"] = F.when(scanned, _gated(c, P.DYNAMIC_JS, DYNAMIC_JS_NEEDLES)).otherwise(0).cast("long")
    css = _gated(c, P.DYNAMIC_CSS, DYNAMIC_CSS_NEEDLES) + _gated(c, P.CSS_IN_JS, CSS_IN_JS_NEEDLES)
    counts["Dynamic_CSS_Gen_Count"] = F.when(scanned, css).otherwise(0).cast("long")
    out = out.withColumns(counts)
    return out.withColumn("Has_Ajax_Calls", F.when(F.col("AJAX_Calls_Count") > 0, "Yes").otherwise("No"))


def inventory(metrics: DataFrame) -> DataFrame:
    """One row per file, without its text."""
    return metrics.select(
        F.col("directory").alias("Directory"), F.col("filename").alias("Filename"), F.col("extension").alias("Extension"), "Size_KB", "Line_Count", *METRICS, "Has_Ajax_Calls", F.col("path").alias("Full_Path")
    )


def ajax_detail_rows(metrics: DataFrame) -> DataFrame:
    """One row per match, in order of occurrence within a file."""
    return metrics.select("path", "filename", F.posexplode_outer("ajax_details").alias("pos", "d")).filter("pos is not null").select(
        F.col("path").alias("File_Path"), F.col("filename").alias("Filename"), F.col("pos").cast("long").alias("Match_No"), F.col("d.line").alias("Line"), F.col("d.code_snippet").alias("Code_Snippet"),
        F.col("d.category").alias("Category"), F.col("d.capability").alias("Capability"), F.col("d.difficulty").alias("Difficulty"), F.col("d.is_counted").alias("Is_Counted"),
    )


def directory_stats(inv: DataFrame) -> DataFrame:
    """Per directory: depth, files, lines, and the count of each extension, sorted by depth and name."""
    by_ext = inv.groupBy("Directory", "Extension").agg(F.count(F.lit(1)).alias("n"), F.sum("Line_Count").alias("lines"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("Extension", "n"))), lambda x: F.concat(x["Extension"], F.lit(": "), x["n"].cast("string"))), ", ")
    out = by_ext.groupBy("Directory").agg(F.sum("n").alias("File_Count"), F.sum("lines").alias("Total_Lines"), text.alias("Extensions_Breakdown"))
    return out.withColumn("Depth", paths.directory_depth(F.col("Directory"))).orderBy("Depth", "Directory")


def complexity_totals(inv: DataFrame) -> DataFrame:
    """Metric and Value rows: files, lines, megabytes, the sums of all counts, and the files with network calls."""
    sums = [F.count(F.lit(1)).cast("double").alias("Total_Files"), F.sum("Line_Count").cast("double").alias("Total_Lines"), F.bround(F.sum(F.col("Size_KB").cast("decimal(20,2)")).cast("double") / 1024, 2).alias("Total_Size_MB")]
    sums += [F.sum(m).cast("double").alias(m) for m in METRICS]
    sums.append(F.count_if(F.col("Has_Ajax_Calls") == "Yes").cast("double").alias("Files_With_Ajax"))
    one = inv.agg(*sums)
    return one.unpivot([], one.columns, "Metric", "Value").withColumn("Value", F.coalesce("Value", F.lit(0.0)))


def extension_breakdown(inv: DataFrame) -> DataFrame:
    return inv.groupBy("Extension").agg(F.count(F.lit(1)).alias("File_Count")).orderBy(F.desc("File_Count"), "Extension")


def scan_footer(inv: DataFrame, details: DataFrame) -> DataFrame:
    """One row of totals of a scan; counted calls come from the detail rows."""
    names = ("Inline_CSS_Count", "Inline_JS_Count", "Internal_Style_Blocks_Count", "Internal_Script_Blocks_Count", "External_Stylesheet_Links_Count", "External_Script_Tags_Count")
    kb = F.sum(F.col("Size_KB").cast("decimal(20,2)")).cast("double")
    left = inv.agg(F.count(F.lit(1)).alias("total_files"), F.countDistinct("Directory").alias("total_dirs"), F.coalesce(F.sum("Line_Count"), F.lit(0)).alias("total_lines"), F.round(F.coalesce(kb, F.lit(0.0)) / 1024, 6).alias("total_size_mb"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    calls = details.agg(F.count_if(F.col("Is_Counted") == "Yes").alias("ajax_calls"))
    return left.join(calls)  # one row beside one row


def folder_progress(inv: DataFrame) -> DataFrame:
    """Per folder: files, inline scripts, inline styles and network calls."""
    return inv.groupBy("Directory").agg(F.count(F.lit(1)).alias("files"), F.sum("Inline_JS_Count").alias("js"), F.sum("Inline_CSS_Count").alias("css"), F.sum("AJAX_Calls_Count").alias("ajax"))


def file_details(inv: DataFrame) -> DataFrame:
    return inv.select(F.col("Directory").alias("Folder_Path"), "Filename", "Extension", "Line_Count", "Size_KB", "Full_Path")


def complexity_metrics(inv: DataFrame) -> DataFrame:
    return inv.select("Full_Path", "Filename", *METRICS, "Has_Ajax_Calls")
