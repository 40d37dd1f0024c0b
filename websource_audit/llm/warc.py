"""WARC archives: write records with revisits for repeated payloads, and read them back by boundary-chain verification.

Reading doesn't trust the magic string, which payloads may hold as well. Tasks emit each place that parses as a record
head, with the place where its successor must be. Pointer jumping from the start of the file along these links keeps
only the records reachable from it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stash

# Fixed values of the WARC 1.1 format.
MAGIC = b"WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always stored.
LEAST_REVISIT_BYTES = 100
#: Records in one archive file, and bytes from which a payload gets a file of its own; files are read whole, one at a time in a task.
FILE_RECORDS, LARGE_BYTES = 256, 1 << 20
#: Digests of repeated payloads that are broadcast; beyond it the pages are joined with them by a shuffle.
BROADCAST_DIGESTS = 100_000

RECORDS = "record_at long, successor long, record_type string, page_id long, url string, refers_to long, content_type string, declared_digest string, payload_bytes long, payload_digest string"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the smallest page_id with an equal payload, if that is another."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    heads = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    heads = heads.filter("n > 1").select("digest", "first_id")
    heads = stash(heads, "payloads")
    if heads.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        heads = F.broadcast(heads)
    other = F.col("first_id") != F.col("page_id")
    return rows.join(heads, "digest", "left").select("page_id", "url", "html", "digest", F.when(other, F.col("first_id")).alias("refers_to"))


def record_text(page_id: Column, url: Column, html: Column, digest: Column, refers_to: Column) -> Column:
    """A whole record but for its end marks. Line ends in a url are percent-encoded; nulls leave their field out."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = refers_to.isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(html)
    clean = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    return F.concat(
        F.lit(MAGIC.decode()),
        F.lit("WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\n"),
        line("WARC-Record-ID", urn(page_id)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("WARC-Refers-To", urn(refers_to)),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        F.lit("Content-Type: text/html\r\n"),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )


def write_archives(pages: DataFrame, path: str | None = None, file_records: int = FILE_RECORDS, large_bytes: int = LARGE_BYTES) -> str:
    """Write one record per page (columns page_id, url, html) as gzipped WARC files; returns their folder.

    A file has at most ``file_records`` records of less than ``large_bytes`` bytes, or one that is larger.

    Null html is an empty payload. Each task writes the archives of its own rows; the end marks of a record are what the
    text writer puts after each value.
    """
    path = path or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = with_revisits(pages)
    text = record_text(*(F.col(c) for c in ("page_id", "url", "html", "digest", "refers_to")))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    for n, part in ((file_records, size < large_bytes), (1, size >= large_bytes)):
        if n > 1 or (pages.agg(F.max(size)).first()[0] or 0) >= large_bytes:
            rows.filter(part).select(text.alias("value")).write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", n).text(path)
    return path


_HEAD = re.compile(rb"WARC/1\.1\r\n((?:[^\r\n]+\r\n)*)\r\n")


def candidates(data: bytes) -> Iterator[tuple]:
    """Each place in a file that parses as a record head, with its successor's place: rows of RECORDS.

    Records of one chain do not overlap, so of what starts inside a record that was hashed nothing can be reached with it: such
    candidates get no digest, and a file is hashed once at most however many heads its payloads hold.
    """
    at, hashed = data.find(MAGIC), 0
    while at >= 0:
        m = _HEAD.match(data, at)
        parts = [x.partition(b": ") for x in m[1].split(b"\r\n")] if m else []
        fields = {name.lower(): value for name, colon, value in parts if colon}
        size = fields.get(b"content-length", b"")
        if size.isdigit() and (end := m.end() + int(size)) <= len(data):
            text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None  # noqa: B023, E731
            page = lambda k: int(x[1]) if (x := re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(k, b""))) else None  # noqa: B023, E731
            digest = text(b"warc-payload-digest")
            own = None
            if at >= hashed:
                own, hashed = hashlib.sha256(memoryview(data)[m.end() : end]).hexdigest(), end
            yield (at, end + len(RECORD_END), text(b"warc-type"), page(b"warc-record-id"), text(b"warc-target-uri"), page(b"warc-refers-to"), text(b"content-type"), digest and digest.removeprefix("sha256:"), end - m.end(), own)
        at = data.find(MAGIC, at + 1)


def reachable(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which of the candidates (sorted places, their successors) a chain from place 0 reaches, by pointer jumping.

    After k rounds the marked ones are the first 2**k of the chain, and each pointer spans 2**k links.
    """
    n = len(at)
    marked = np.zeros(n + 1, bool)
    if n and at[0] == 0:
        marked[0] = True
    k = np.searchsorted(at, successor)
    jump = np.append(np.where((k < n) & (at[np.minimum(k, n - 1)] == successor), k, n), n) if n else np.zeros(1, np.int64)
    while True:
        more = marked.copy()
        more[jump[marked]] = True
        more[n] = marked[n]
        if (more == marked).all():
            return marked[:n]
        marked, jump = more, jump[jump]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per verified record of the (gzipped or plain) WARC files under ``path``: archive, then RECORDS.

    Tasks emit candidate links of the files they read; the links of each file then meet for the pointer jumping. What
    comes before the first record, after a broken link, or inside a payload is not reached and gives no row.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["archive", *(x.strip().split(" ")[0] for x in RECORDS.split(","))]
        for b in batches:
            for k in range(b.num_rows):
                archive, data = b.column("path")[k].as_py(), b.column("content")[k].as_py()
                if data[:2] == b"\x1f\x8b":
                    whole = []
                    while data:
                        member = zlib.decompressobj(31)
                        whole += [member.decompress(data), member.flush()]
                        data = member.unused_data
                    data = b"".join(whole)
                rows = [(archive, *r) for r in candidates(data)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def keep(links):  # a file's links: pandas in, pandas out
        links = links.sort_values("record_at", ignore_index=True)
        return links[reachable(links["record_at"].to_numpy(), links["successor"].to_numpy())]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    links = files.mapInArrow(emit, f"archive string, {RECORDS}")
    return links.groupBy("archive").applyInPandas(keep, f"archive string, {RECORDS}")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per record: page_id, url, record_type, refers_to, and size and digest of the full payload, a revisit's from the response it names.

    A response is named by its page_id and the digest that the revisit declares, so ids may repeat; equal responses count
    once. A revisit that names none has a null size and digest. Responses are few to each name, so the revisits of one response,
    however many, are only looked up.
    """
    revisit = F.col("record_type") == "revisit"
    heads = records.filter(~revisit).select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest"), F.col("payload_bytes").alias("full_bytes"))
    heads = heads.dropDuplicates(["refers_to", "declared_digest"])
    stored = records.filter(~revisit).select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")
    again = records.filter(revisit).select("page_id", "url", "record_type", "refers_to", "declared_digest").join(heads, ["refers_to", "declared_digest"], "left")
    full = F.when(F.col("full_bytes").isNotNull(), F.col("declared_digest"))
    return stored.unionByName(again.select("page_id", "url", "record_type", "refers_to", F.col("full_bytes").alias("payload_bytes"), full.alias("payload_digest")))
