"""Findings of inline, internal and external code in files, and their enrichment."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import ajax, paths, scoring
from ..functions import patterns as P
from ..functions.html_tokens import document_findings, placed_findings
from ..sources.shared import written
from .reports import add_row_ids

FINDINGS = "file_path string, rel_path string, finding_no long, start_line long, end_line long, category string, code_type string, source_type string, snippet string, full_code string, html_context string"
#: Where a finding stands in its file; findings are in this order.
PLACE = ("kind", "tag_no", "attribute_no", "part")


def extract_findings(files: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per finding of each file (columns path, rel_path, content), duplicates within a file dropped.

    finding_no is the order within the file. Files are read and tokenized one at a time, and a file's rows go out before the next
    one is read. A null content has none. With ``carried`` (columns of files), rows have these columns and PLACE as well.
    """
    schema = FINDINGS + "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in carried) + "".join(f", {c} long" for c in PLACE if carried)
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, rel, content = (c[k].as_py() for c in b.columns[:3])
                if content is not None and (found := placed_findings(path, content)):
                    places, rows = zip(*found, strict=True)
                    n = len(found)
                    arrays = [pa.array(x) for x in ([path] * n, [rel] * n, range(n), *zip(*rows, strict=True))]
                    if carried:
                        arrays += [pa.array([c[k].as_py()] * n, c.type) for c in b.columns[3:]] + [pa.array(x) for x in zip(*places, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return files.select("path", "rel_path", "content", *carried).mapInArrow(run, schema)


class FindingsOf:
    """The table function behind ``register_findings``: the findings of one text."""

    def eval(self, path: str, content: str | None) -> Iterator[tuple]:
        if content is not None:
            for k, row in enumerate(document_findings(path or "", content)):
                yield (k, *row)


def register_findings(spark: SparkSession, name: str = "html_findings") -> None:
    """Make extract_findings a table function of SQL: ``SELECT ... FROM files, LATERAL html_findings(path, content)``."""
    schema = FINDINGS.split("rel_path string, ", 1)[1]
    spark.udtf.register(name, udtf(FindingsOf, returnType=schema))


def dedup_findings(findings: DataFrame) -> DataFrame:
    """For findings read back from tables: the first of each (file, start line, type, stripped code)."""
    code = F.xxhash64(F.regexp_replace("full_code", r"^(?U)\s+|\s+$", ""))
    return findings.withColumn("_code", code).groupBy("file_path", "start_line", "code_type", "_code").agg(F.min_by(F.struct(*findings.columns), "finding_no").alias("f")).select("f.*")


def block_findings(files: DataFrame) -> DataFrame:
    """Script and style blocks taken by pattern, without a tokenizer: the native alternative for blocks in text tables.

    Columns as of extract_findings; a script with a src attribute is no block.
    """
    js = F.transform(ajax.matches(F.col("content"), P.INTERNAL_SCRIPT), lambda m: F.struct(m["line"].alias("line"), m["text"].alias("text"), F.lit("JS").alias("category"), F.lit("scriptblock").alias("code_type")))
    css = F.transform(ajax.matches(F.col("content"), P.INTERNAL_STYLE), lambda m: F.struct(m["line"].alias("line"), m["text"].alias("text"), F.lit("CSS").alias("category"), F.lit("styleblock").alias("code_type")))
    rows = files.select(F.col("path").alias("file_path"), "rel_path", F.posexplode_outer(F.concat(js, css)).alias("finding_no", "b")).filter("finding_no is not null")
    code = F.regexp_replace(F.regexp_replace(F.col("b.text"), r"(?is)^<[^>]*>\s*", ""), r"(?is)\s*</[a-z]+>$", "")
    feeds = F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit("")))
    out = rows.select(
        "file_path", "rel_path", F.col("finding_no").cast("long").alias("finding_no"), F.col("b.line").alias("start_line"), (F.col("b.line") + feeds).cast("long").alias("end_line"), F.col("b.category").alias("category"),
        F.col("b.code_type").alias("code_type"), F.lit("INLINE").alias("source_type"), F.substring(code, 1, 200).alias("snippet"), code.alias("full_code"), F.lit("").alias("html_context"),
    )
    return out.filter((F.col("category") == "CSS") | (F.col("full_code") != ""))


def enrich_findings(findings: DataFrame) -> DataFrame:
    """Add network calls, dynamic code, scores and recommendations; calls and dynamic code for scripts only."""
    js = F.col("category") == "JS"
    code = F.col("full_code")
    out = findings.withColumn("ajax_details", F.when(js, ajax.details(code, F.col("start_line"), "static")).otherwise(F.array().cast(ajax.DETAILS)))
    first = F.get(F.col("ajax_details"), F.lit(0))
    out = out.withColumns(
        {
            "ajax_detected": F.size("ajax_details") > 0,
            "ajax_count": ajax.counted(F.col("ajax_details")),
            "ajax_pattern": F.coalesce(F.concat(first["category"], F.lit(" ("), first["capability"], F.lit(")")), F.lit("")),
            "capability": F.coalesce(first["capability"], F.lit("")),
            "difficulty": F.coalesce(first["difficulty"], F.lit("")),
            "endpoint_url": F.coalesce(first["endpoint"], F.lit("")),
        }
    )
    found = F.col("ajax_detected")
    dynamic = F.when(js, scoring.dynamic_code(code)).otherwise(F.struct(F.lit(False).alias("dynamic_code_detected"), F.lit(0).cast("long").alias("dynamic_count"), F.lit("").alias("dynamic_pattern")))
    out = out.withColumns({"has_server_deps": found & ajax.has_server_deps(code), "is_inline_ajax": found & ajax.is_inline_ajax(F.col("file_path")), "_d": dynamic, "logic_density_score": scoring.logic_density_score(code, found)})
    out = out.withColumns({**{c: F.col(f"_d.{c}") for c in ("dynamic_code_detected", "dynamic_count", "dynamic_pattern")}, "complexity": scoring.complexity(F.col("logic_density_score")), "server_severity": scoring.server_severity(code), "functionality": scoring.functionality(code, found)}).drop("_d")
    ids = (F.col("rel_path"), F.col("code_type"), F.col("start_line"), F.col("end_line"), F.col("category"))
    bundled = F.col("category").isin("JS", "CSS") & (F.length(code) > 0)
    return out.withColumns(
        {
            "refactor_status": scoring.refactor_status(F.col("server_severity"), F.col("complexity")),
            "recommended_method": scoring.recommended_method(F.col("server_severity"), F.col("complexity")),
            "target_filename": scoring.target_filename(*ids),
            "bundled_file": F.when(bundled, scoring.bundle_filename(*ids)).otherwise(""),
        }
    )


def ajax_code_report(findings: DataFrame) -> DataFrame:
    """One row per network call of enriched findings; `#` numbers are added by add_row_ids where they are wanted."""
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    rows = findings.select("*", F.posexplode_outer("ajax_details").alias("match_no", "d")).filter("match_no is not null")
    return rows.select(
        F.col("file_path").alias("File_Path"), paths.filename(F.col("rel_path")).alias("File_Name"), "finding_no", F.col("match_no").cast("long").alias("match_no"), F.col("d.category").alias("Category"), F.col("d.capability").alias("Capability"),
        F.col("d.is_counted").alias("Is_Valid_Call"), F.col("d.line").alias("Start_Line"), F.col("end_line").alias("End_Line"), F.col("d.endpoint").alias("Endpoint"), yes(F.col("has_server_deps")).alias("Has_Server_Dependencies"),
        yes(F.col("source_type") == "INLINE").alias("Is_Inline"), yes(F.col("source_type") == "LOCAL").alias("Is_Internal"), yes(F.col("source_type") == "REMOTE").alias("Is_External"), F.col("d.code_snippet").alias("Code_Snippet"),
    )


def dynamic_findings(pages: DataFrame) -> DataFrame:
    """Findings of stored pages (page_id, url, content) that call the network; file_path is the url.

    Pages of one url are one file: their findings are numbered together, by place, then by page, and of those with equal start
    line, type and stripped code the first stays. A page without a url has none. Findings are written once; only those of
    urls with several pages move to be numbered, without their code.
    """
    files = pages.filter("url is not null").select(F.col("url").alias("path"), F.col("url").alias("rel_path"), "content", "page_id", F.monotonically_increasing_id().alias("page_no"))
    found = written(extract_findings(files, ("page_id", "page_no")), "found")
    several = found.groupBy("file_path").agg((F.min("page_no") < F.max("page_no")).alias("several")).filter("several")
    code = F.xxhash64(F.regexp_replace("full_code", r"^[\t\n\f\r ]+|[\t\n\f\r ]+\z", "")).alias("code")
    order = [*PLACE, "page_id", "page_no"]
    first = found.join(several, "file_path", "left_semi").groupBy("file_path", "start_line", "code_type", code).agg(F.min(F.struct(*order, "finding_no")).alias("at"))
    numbered = add_row_ids(first.select("file_path", "at.*"), order, by="file_path", name="no").select("file_path", "page_no", "finding_no", "no")
    calls = enrich_findings(found).filter("ajax_detected").join(several, "file_path", "left").join(numbered, ["file_path", "page_no", "finding_no"], "left")
    calls = calls.filter("several is null or no is not null").withColumn("finding_no", F.coalesce(F.col("no") - 1, "finding_no"))
    return calls.drop("several", "no", "page_id", "page_no", *PLACE)
