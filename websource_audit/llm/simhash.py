"""SimHash near copies by covering locality-sensitive hashing: no pair within the radius is missed.

A table of the index keeps some of the 64 bits, its mask, and two fingerprints meet in it if they agree on them. Each bit has a
vector of radius + 1 zeros and ones, not all zero; table v (of 2**(radius + 1) - 1) keeps the bits whose vector has an odd number of
ones in common with v. The vectors of at most ``radius`` bits span less than the whole space, so some v has an even number in
common with all of them: whatever these bits are, the two fingerprints meet in that table.

A bucket with more than BUCKET different fingerprints is refined: the same construction over the bits that its mask leaves open
makes smaller buckets, again without loss, until a bucket has few fingerprints or 10 open bits. So no task takes a large group of
similar ones, and two refinements are the most. In a bucket links are kept as a spanning forest,
one link at most for each fingerprint, which joins what all pairs would join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, slices, small_batches, stash, words_of
from .components import components

BITS, SHINGLE_WORDS, RADIUS, SEED = 64, 3, 3, 42
#: Different fingerprints of a bucket that are compared in one task; larger buckets are refined.
BUCKET = 1024
#: Buckets with at most so many open bits hold at most 2**10 fingerprints and are never refined.
CLOSED = 10
#: Buckets of at most so many are compared by shifts of whole columns.
FEW = 8
#: Shingles hashed at once.
WINDOW = 1 << 16
#: Fingerprints of more than one in so many rows (there are fewer than that) get their component by a broadcast.
HOT_SHARE = 1000
#: Large buckets whose keys are broadcast; beyond it they are found by a shuffle.
BROADCAST_KEYS = 500_000


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 where over half of the shingles' hashes have it; a text without words has none, so 0."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle_words, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), WINDOW):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + WINDOW], ends[k : k + WINDOW], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            known: dict[str | None, int] = {}
            for t in column(b, "t"):
                if t not in known:
                    known[t] = fingerprint(t, shingle_words)
            fps = np.fromiter((known[t] for t in column(b, "t")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def covering_masks(open_bits: int, radius: int) -> list[int]:
    """Masks over ``open_bits``: whatever ``radius`` of these bits are, some mask has none of them."""
    places = [k for k in range(BITS) if open_bits >> k & 1]
    tables = (1 << radius + 1) - 1
    return [sum(1 << p for i, p in enumerate(places) if (v & 1 + i % tables).bit_count() & 1) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def _forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all pairs of ``x`` within the radius join: each member with the first one that it reaches."""
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    root = np.arange(len(x))
    while True:
        low = np.where(near, root[None, :], len(x)).min(axis=1)
        low = low[low]
        if (low == root).all():
            break
        root = low
    moved = np.flatnonzero(root != np.arange(len(x)))
    return x[root[moved]], x[moved]


def _links(radius: int):
    """Links within the buckets of rows (kept, key, fp) sorted by bucket."""

    def of(kept: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], (kept[1:] != kept[:-1]) | (key[1:] != key[:-1]), [True]]))
        size = np.diff(edge)
        out = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
        for s, n in zip(edge[:-1][size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            out.append(_forest(np.unique(fp[s : s + n]), radius))
        left = np.where(size <= FEW, size, 0)
        rest = np.repeat(edge[1:], size) - np.arange(len(fp))  # how many of its bucket stand from each row on
        rows = np.flatnonzero(np.repeat(left, size) > 1)
        for lag in range(1, FEW):
            rows = rows[rest[rows] > lag]
            if not len(rows):
                break
            a, b = fp[rows], fp[rows + lag]
            near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
            out.append((a[near], b[near]))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.empty(0, np.int64) for _ in range(3))
        for batch in batches:
            held = tuple(np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held))
            kept, key, fp = held
            last = np.flatnonzero((kept != kept[-1]) | (key != key[-1]))
            done = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
            if done:
                yield of(kept[:done], key[:done], fp[:done].view(np.uint64))
                held = kept[done:], key[done:], fp[done:]
        if len(held[0]):
            yield of(held[0], held[1], held[2].view(np.uint64))

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join the different fingerprints (fp) of ``fps`` as all pairs within the radius would."""
    spark = fps.sparkSession
    masks = covering_masks((1 << BITS) - 1, radius)
    entries = fps.select(F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks))).alias("kept"), "fp")
    out = None
    while True:
        entries = entries.withColumn("key", F.col("fp").bitwiseAND(F.col("kept")))
        wide = F.bit_count(F.bitwise_not("kept")) > CLOSED
        large = stash(entries.filter(wide).groupBy("kept", "key").count().filter(F.col("count") > bucket).select("kept", "key"), "large")
        few = large.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        keys = F.broadcast(large) if few else large
        small = entries.join(keys, ["kept", "key"], "left_anti").select("kept", "key", "fp")
        found = small.repartition("kept", "key").sortWithinPartitions("kept", "key").mapInArrow(_links(radius), "a long, b long")
        found = stash(found.distinct(), "links")
        out = found if out is None else out.unionByName(found)
        if large.isEmpty():
            return out
        masks = [m for m in dict.fromkeys(masks) if BITS - m.bit_count() > CLOSED]
        finer = [(_signed(m), _signed(m | sub)) for m in masks for sub in covering_masks((1 << BITS) - 1 & ~m, radius)]
        masks = [b % (1 << BITS) for _, b in finer]
        steps = spark.createDataFrame(finer, "kept long, finer long").distinct()
        again = entries.join(keys, ["kept", "key"], "left_semi").join(F.broadcast(steps), "kept").select(F.col("finer").alias("kept"), "fp")
        entries = stash(again.distinct(), "finer")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id that links reach.

    Rows link by fingerprint: those at ``radius`` or fewer differing bits. Null and empty texts, and those of white space only, have
    fingerprint 0 and link like any other; so do rows that repeat, and rows of one id with different texts, each by its
    own fingerprint. A null id is in its component without giving it a name, which is null if there is no other id.
    Other columns of ``docs`` take no part. An empty table gives an empty one.
    """
    prints = stash(fingerprints(docs, id_col, text_col, shingle_words), "prints")
    fps = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fps")
    found = links(fps.select("fp"), radius, bucket)
    roots = components(found).select(F.col("node").alias("fp"), "root")
    linked = stash(roots.join(fps.select("fp", "first"), "fp"), "linked")
    names = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = stash(linked.select("fp", "root").join(names, "root").select("fp", "component_id", F.lit(True).alias("linked")), "named")
    named = fps.join(linked, "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    named = stash(named, "components")
    discard(fps)
    hot = F.col("n") > F.lit(max(HOT_SHARE, prints.count() // HOT_SHARE))
    many, rest = F.broadcast(named.filter(hot).drop("n")), named.filter(~hot).drop("n")
    return prints.join(many, "fp").unionByName(prints.join(many, "fp", "left_anti").join(rest, "fp")).select("doc_id", "fp", "component_id")
