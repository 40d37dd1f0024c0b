"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed by the SHA-256 of its text. A ledger holds the (blob, rule, version)
triples already scanned with what they gave. A run scans only the triples that the ledger lacks, each blob once however
many paths and versions share it, and joins the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import BLOCK, let, running_max, running_sums
from .common import stash


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``group`` is the part of a match that must have ``least`` characters; ``gate`` is a cheap test."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    gate: str


# The three base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
#: Kinds of our own, added beside the base ones.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
)
RULES = BASE_RULES + MORE_RULES

#: Hashes of blobs to scan that are broadcast; beyond it texts are picked by a shuffle.
BROADCAST_BLOBS = 100_000
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: What a ledger keeps of a span: its kind is the row's, and its rank that of the kind among the rules of whoever reads it.
PLACES = "array<struct<start:int,end:int>>"


def places_of(text: Column, rule: Rule) -> Column:
    """Spans of one rule, in code points, end exclusive: leftmost non-overlapping matches, failing ones dropped.

    The start of match i is the length of all pieces and matches before it; both calls cut the text alike.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    sizes = F.zip_with(F.arrays_zip(whole.alias("w"), part.alias("p")), F.slice(pieces, 1, F.size(whole)), lambda m, before: F.struct(F.length(before).alias("before"), F.length(m["w"]).alias("len"), F.length(m["p"]).alias("part")))

    def spans(cells: Column) -> Column:
        ends = running_sums(F.transform(cells, lambda c: c["before"] + c["len"]))
        rows = F.zip_with(cells, ends, lambda c, end: F.when(c["part"] >= rule.least, F.struct((end - c["len"]).alias("start"), end.alias("end"))))
        return F.filter(rows, lambda r: r.isNotNull()).cast(PLACES)

    return F.when(text.rlike(rule.gate), let(sizes, spans)).otherwise(F.array().cast(PLACES))


def blob_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob_id): the content address of each version; a null text is the empty blob."""
    return docs.select(F.col(id_col).alias("path"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob_id"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Ledger rows that are new: one per unseen (blob, rule version) with a finding or without.

    Each distinct text is scanned once: copies meet by content address, after each task has merged its own. Rules whose
    version the ledger has for a blob are not evaluated on it. A blob new to the ledger gives one row for each rule. With a ledger,
    hashes are compared first, and only texts of blobs that it lacks a rule for are moved.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.sha2(text, 256).alias("blob_id"), text.alias("blob"))
    none = F.array().cast("array<string>")
    if ledger is None:
        blobs = rows.groupBy("blob_id").agg(F.first("blob").alias("blob")).withColumn("done", none)
    else:
        done = ledger.groupBy("blob_id").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("done"))
        known = F.array(*(F.lit(f"{r.kind}@{r.version}") for r in rules))
        lacking = docs.select(F.sha2(text, 256).alias("blob_id")).distinct().join(done, "blob_id", "left").select("blob_id", F.coalesce("done", none).alias("done"))
        lacking = stash(lacking.filter(F.size(F.array_except(known, "done")) > 0), "lacking")
        few = lacking.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS
        ids = lacking.select("blob_id")
        moved = rows.join(F.broadcast(ids) if few else ids, "blob_id", "left_semi")
        blobs = moved.groupBy("blob_id").agg(F.first("blob").alias("blob")).join(lacking, "blob_id")
    rows = []
    for rule in rules:
        fresh = ~F.array_contains("done", f"{rule.kind}@{rule.version}")
        rows.append(F.when(fresh, F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), places_of(F.col("blob"), rule).alias("spans"))))
    return blobs.select("blob_id", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("blob_id", "r.kind", "r.version", "r.spans")


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger with this run's rows added, written to the shared folder."""
    new = scan_unseen(docs, ledger, rules, text_col)
    return stash(new if ledger is None else ledger.unionByName(new), "ledger")


def hits(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, spans) of the blobs with findings by the current rule versions, by start, then kind as listed in ``rules``.

    It is written: so Spark can split a blob that very many paths share.
    """
    current = F.concat_ws("@", "kind", "version").isin([f"{r.kind}@{r.version}" for r in rules])
    rank = F.element_at(F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k))), F.col("kind"))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind")))
    rows = ledger.filter(current & (F.size("spans") > 0)).select("blob_id", spans.alias("spans"))
    return stash(rows.groupBy("blob_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).cast(SPANS).alias("spans")), "hits")


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` as (path, spans): the spans of the current rule versions, by start, then kind as listed.

    Repeated rows give repeated rows; a null id stays null; paths without findings have an empty array.
    """
    return blob_versions(docs, id_col, text_col).join(hits(ledger, rules), "blob_id", "left").select("path", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, spans) of every row after bringing the ledger up to date."""
    return findings(docs, update_ledger(docs, ledger, rules, text_col), rules, id_col, text_col)


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``.

    What stays is cut out in pieces, a block of them at a time from the part of the text that holds the block, and joined once.
    """

    def cut(ends: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1)).cast("long")
        starts = F.filter(F.transform(spans, lambda s, k: F.struct(before(k).alias("from"), s["start"].cast("long").alias("to"))), lambda c: c["to"] >= c["from"])

        def piece(whole: Column, low: Column, c: Column) -> Column:
            return F.concat(F.substring(whole, (c["from"] - low + 1).cast("int"), (c["to"] - c["from"]).cast("int")), F.lit(mark))

        def block(cells: Column) -> Column:
            low, high = F.get(cells, F.lit(0))["from"], F.element_at(cells, -1)["to"]
            return let(F.substring(text, (low + 1).cast("int"), (high - low).cast("int")), lambda part: F.array_join(F.transform(cells, lambda c: piece(part, low, c)), ""))

        def whole(cells: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(1), F.size(cells), F.lit(BLOCK)), lambda k: let(F.slice(cells, k, F.lit(BLOCK)), block))
            rest = F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text))
            return F.concat(F.array_join(blocks, ""), rest)

        return let(starts, whole)

    ends = running_max(F.transform(spans, lambda s: s["end"].cast("long")))
    return F.when(F.size(spans) == 0, text).otherwise(let(ends, cut))


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The documents with every finding redacted: columns and rows as given, a character count brought up to date.

    A null text stays null. Documents without findings are unchanged. Columns may have any names.
    """
    found = hits(update_ledger(docs, None, rules, text_col), rules)
    out = docs.join(found, F.sha2(docs[text_col], 256) == found["blob_id"], "left")
    has = found["spans"].isNotNull()
    clean = F.when(has, redact(docs[text_col], found["spans"])).otherwise(docs[text_col])
    made = []
    for c in docs.columns:
        if c == text_col:
            made.append(clean.alias(c))
        elif c == count_col:
            made.append(F.when(has, F.length(clean)).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c))
        else:
            made.append(docs[c])
    return out.select(*made)
