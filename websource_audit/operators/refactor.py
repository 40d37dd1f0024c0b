"""Assessment of extracted blocks, their original files, and a plan of refactoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, scoring
from ..functions import patterns as P
from ..sources.shared import written


def assessment_rows(extracted: DataFrame) -> DataFrame:
    """One row per extracted block (filename, category, content): where it came from, its state, and what to do."""
    rows = extracted.select("filename", "category", "content", scoring.parse_extracted_filename(F.col("filename")).alias("p"), scoring.classify_code(F.col("filename"), F.col("content")).alias("c"))
    snippet = F.trim(F.replace(F.substring("content", 1, 150), F.lit("\n"), F.lit(" ")))
    return rows.select(
        "filename", F.col("p.original_path").alias("original_file"), F.col("p.line_range").alias("lines"), F.col("p.code_type").alias("code_type"), "category", F.col("c.state").alias("state"), F.col("c.complexity").alias("complexity"),
        F.col("c.status").alias("status"), F.col("c.action").alias("action"), F.col("c.reason").alias("reason"), F.col("c.razor_tokens").alias("razor_tokens"), F.col("c.is_ajax").alias("ajax"), snippet.alias("snippet"),
    )


def refactorability_index(assessed: DataFrame) -> DataFrame:
    """One row: blocks, clean, bridgeable, inline ones of these, and the weighted share that can be refactored."""
    good = F.col("state").isin("A", "B")
    one = assessed.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "A").alias("clean"), F.count_if(F.col("state") == "B").alias("bridge"), F.count_if((F.col("category") == "inline") & good).alias("inline"))
    share = (F.col("clean") + F.col("bridge") + F.col("inline") * 0.8) / F.col("total") * 100
    return one.withColumn("refactorability", F.round(F.when(F.col("total") > 0, share).otherwise(0.0), 2))


def sanitized(path):
    return F.translate(path, "/\\", "__")


def _suffixes(rows: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """``rows`` with each end of ``column`` that has one of ``lengths`` characters but is shorter than the whole, as tail."""
    given = F.array(*(F.lit(n) for n in lengths)).cast("array<int>")
    n = F.explode(F.filter(given, lambda x: x < F.length(column))).alias("_n")
    return rows.select("*", n).withColumn("tail", F.substring(F.col(column), F.length(column) - F.col("_n") + 1, F.col("_n"))).drop("_n")


def _lengths(rows: DataFrame, column: str) -> list[int]:
    """The different lengths that occur; paths have few."""
    return sorted(r[0] for r in rows.select(F.length(column)).distinct().collect())


def resolve_original_file(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(block_path, rel_path): each distinct sanitized block path with its original file, or null.

    An equal sanitized name wins; of several the smallest. Else names that end with one another are candidates, taken only if
    there is just one. A block path is met with the ends of names that have its length, and a name with the ends of block
    paths that have its length, so only names that do end with one another share a key. Of a key only the number of its files
    and the smallest one go on, so it costs one row however many files have it. Null paths take no part.
    """
    b = written(blocks.select("block_path").filter("block_path is not null").distinct(), "blocks")
    f = files.filter("rel_path is not null").groupBy(sanitized(F.col("rel_path")).alias("name")).agg(F.min("rel_path").alias("rel_path"), F.count(F.lit(1)).alias("n"))
    f = written(f, "names")
    exact = written(b.join(f, F.col("block_path") == F.col("name")).select("block_path", "rel_path"), "exact")
    rest = written(b.join(exact, "block_path", "left_anti"), "unresolved")
    ends = _suffixes(f, "name", _lengths(rest, "block_path")).groupBy("tail").agg(F.min("rel_path").alias("rel_path"), F.sum("n").alias("n"))
    longer = rest.join(ends, F.col("block_path") == F.col("tail")).select("block_path", "rel_path", "n")
    shorter = _suffixes(rest, "block_path", _lengths(f, "name")).join(f, F.col("tail") == F.col("name")).select("block_path", "rel_path", "n")
    single = longer.unionByName(shorter).groupBy("block_path").agg(F.sum("n").alias("n"), F.min("rel_path").alias("rel_path")).filter("n = 1").drop("n")
    return b.join(exact.unionByName(single), "block_path", "left")


def refactor_plan(findings: DataFrame) -> DataFrame:
    """What to do with script blocks and handlers of findings: leave, mark for manual work, bridge, or move to a listener.

    new_file and replacement are null where nothing moves; code is the moved file's text.
    """
    block = F.col("code_type") == "scriptblock"
    code = F.col("full_code")
    manual = code.rlike(r"@if|@foreach|@for|@while")
    mark = F.substring(F.md5(code), 1, 8)
    own_id = F.regexp_extract("html_context", r'\sid="([^"]*)"', 1)
    element = F.when(own_id != "", own_id).otherwise(F.concat(F.lit("ref-"), mark))
    event = F.expr("substring(code_type, 3)")
    name = paths.filename(F.col("rel_path"))
    action = F.when(~block, "listener").when(~code.contains("@"), "leave").when(manual, "todo").otherwise("bridge")
    file = F.when(~block, F.concat(F.lit("/js/inline/"), name, F.lit("_"), F.col("code_type"), F.lit("_"), mark, F.lit(".js"))).when(action == "bridge", F.concat(F.lit("/js/internal/"), name, F.lit("_script_"), mark, F.lit(".js")))
    wrapper = F.format_string("document.addEventListener('DOMContentLoaded', function () { var el = document.getElementById('%s'); if (el) { el.addEventListener('%s', function (event) { %s }); } });", element, event, code)
    rows = findings.filter((F.col("category") == "JS") & (block | F.col("code_type").isin(*P.REFACTORED_EVENTS)))
    return rows.select(
        "file_path", "finding_no", "start_line", "code_type", action.alias("action"), F.when(~block, element).alias("element_id"), file.alias("new_file"),
        F.when(file.isNotNull(), F.concat(F.lit('<script src="'), file, F.lit('"></script>'))).alias("replacement"), F.when(~block, wrapper).when(action == "bridge", code).alias("code"),
    )


def bottom_scripts(plan: DataFrame) -> DataFrame:
    """Per page the references to append at the end of its body, in order."""
    rows = plan.filter("action = 'listener'").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("finding_no", "new_file"))).alias("s"))
    return rows.select("file_path", F.array_join(F.transform("s", lambda x: x["new_file"]), ", ").alias("scripts"), F.size("s").cast("long").alias("n_scripts"))


def extracted_blocks(findings: DataFrame) -> DataFrame:
    """Bundled findings in the form of extracted files: name with its _line range, category and content."""
    kind = F.when((F.col("code_type").isin("scriptblock", "styleblock")) | (F.col("source_type") == "LOCAL"), "internal").otherwise("inline")
    ext = F.when(F.col("category") == "JS", ".js").otherwise(".css")
    safe = F.regexp_replace("code_type", r"[^A-Za-z0-9]", "")
    name = F.concat(sanitized(F.col("rel_path")), F.lit("_"), safe, F.lit("_line"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), ext)
    return findings.filter(F.col("category").isin("JS", "CSS") & (F.length("full_code") > 0)).select("file_path", "rel_path", name.alias("filename"), kind.alias("category"), F.col("full_code").alias("content"))
