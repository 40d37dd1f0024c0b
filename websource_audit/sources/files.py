"""Source trees, stored pages and report tables: reading and writing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .tree import UNREAD, load_tree

EXTRACTED_FOLDERS = ("inline_js", "internal_js", "inline_css", "internal_css")


def with_path_columns(df: DataFrame) -> DataFrame:
    """Add directory, filename, extension and depth to rows that have rel_path."""
    folder = paths.directory(F.col("rel_path"))
    name = paths.filename(F.col("rel_path"))
    return df.withColumns({"directory": folder, "filename": name, "extension": paths.extension(name), "depth": paths.directory_depth(folder)})


def read_source_tree(spark: SparkSession, root: str, unread: tuple[str, ...] = UNREAD, max_bytes: int | None = None, by_spark: bool = False) -> DataFrame:
    """Every file below ``root``: path, rel_path, directory, filename, extension, depth, size_bytes, bytes.

    Folders are shared out to tasks, which list and read them; the driver keeps no file names. Files above ``max_bytes`` are not
    opened, nor are folders in ``unread``. This needs a store that pyarrow reaches; ``by_spark`` takes Spark's own reader,
    which reaches others but passes over names that start with a dot or an underscore.
    """
    if not by_spark:
        files = load_tree(spark, root, unread, max_bytes).withColumnRenamed("content", "bytes")
    else:
        tail = "/" + root.split("://", 1)[-1].strip("/").split("/", 1)[-1] + "/" if "://" in root else root.rstrip("/") + "/"
        rel = F.substring(F.col("path"), F.locate(tail, F.col("path")) + len(tail), F.length("path"))
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", rel.alias("rel_path"), "length", F.col("content").alias("bytes"))
        files = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    return with_path_columns(files.select("path", "rel_path", F.col("length").alias("size_bytes"), "bytes"))


#: Characters of the bytes 80 to 9F in windows-1252, in order; five of these bytes have none.
WINDOWS_1252 = "\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178"
NO_WINDOWS = "\x81\x8d\x8f\x90\x9d"
_HIGH = "".join(c for c in map(chr, range(0x80, 0xA0)) if c not in NO_WINDOWS)
# hexadecimal texts of UTF-16 without its mark, low byte first and high byte first: surrogates in pairs only
_LITTLE = r"^FFFE(?:..(?:[0-9ABCEF].|D[0-7])|..D[89AB]..D[C-F])*+$"
_BIG = r"^FEFF(?:(?:[0-9ABCEF].|D[0-7])..|D[89AB]..D[C-F]..)*+$"


def decode_content(df: DataFrame, bytes_col: str = "bytes") -> DataFrame:
    """Add content and encoding: UTF-8 where the bytes are that, else UTF-16 by its byte order mark, else windows-1252, else latin-1.

    Line ends become line feeds; null bytes give null. A byte that windows-1252 lacks makes a text latin-1, which takes any byte;
    so does every text with a mark that is no UTF-16 behind it. All of it is a projection of built-in functions.
    """
    raw = F.col(bytes_col)
    marked = F.hex(F.substring(raw, 1, 2)).isin("FFFE", "FEFF")
    wide = F.when(marked, F.hex(raw).rlike(_LITTLE) | F.hex(raw).rlike(_BIG)).otherwise(F.lit(False))
    single = F.decode(raw, "ISO-8859-1")
    encoding = (
        F.when(raw.isNull(), F.lit(None).cast("string"))
        .when(F.is_valid_utf8(raw.cast("string")), "utf-8")
        .when(wide, "utf-16")
        .when(single.rlike(f"[{NO_WINDOWS}]"), "latin-1")
        .otherwise("windows-1252")
    )
    out = df.withColumn("encoding", encoding)
    e = F.col("encoding")
    content = F.when(e == "utf-8", raw.cast("string")).when(e == "utf-16", F.decode(raw, "UTF-16")).when(e == "latin-1", single).when(e == "windows-1252", F.translate(single, _HIGH, WINDOWS_1252))
    return out.withColumn("content", F.regexp_replace(content, "\r\n?", "\n")).select(*(c for c in df.columns if c not in (bytes_col, "content", "encoding")), "content", "encoding")


def decode_ignoring(raw: Column) -> Column:
    """UTF-8 with bad bytes left out, as the depth tool reads: what replaces them is dropped."""
    return F.regexp_replace(F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit("")), "\r\n?", "\n")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages as assets (url, type, content) that are analysed like files with the url as file_path."""
    return spark.read.parquet(path).select(F.col("url"), F.lit("html").alias("type"), F.coalesce("html", F.lit("")).alias("content"), F.col("url").alias("file_path"))


def report_versions(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified) of the versions of a report that were written to their end."""
    return spark.read.schema("path string, modified timestamp").parquet(f"{path}/versions")


def read_report(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of a report's latest version."""
    return spark.read.parquet(f"{latest_report(report_versions(spark, path)).first().path}/{name}")


def write_report(tables: dict[str, DataFrame], path: str) -> str:
    """One table for each tab, in a folder of its own; the folder counts once all tables are there, and is returned.

    A row is added to the table of versions at the end, so readers see the old report whole until then, and after a failure.
    """
    folder = f"{path}/report-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).coalesce(1).select(F.lit(folder).alias("path"), F.current_timestamp().alias("modified")).write.mode("append").parquet(f"{path}/versions")
    return folder


def write_extracted_code(bundle: DataFrame, path: str) -> None:
    """Code by (folder, file name), one partition for each of the four folders."""
    bundle.write.mode("overwrite").partitionBy("folder").parquet(path)


def latest_report(reports: DataFrame) -> DataFrame:
    """Of (path, modified) rows, the path with the latest time; of equal times the last path."""
    return reports.agg(F.max_by("path", F.struct("modified", "path")).alias("path"))
