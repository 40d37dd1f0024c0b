"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

The product is taken only over the entries that the size-derived bound leaves: two sets at similarity t share at least
ceil(t n) of the n entries of either, so they meet in the first n - ceil(t n) + 1 entries of both under any one order of
the n-grams. The order puts n-grams known to be common last.

It is a masked product. Its first columns, where similar sets must meet, are multiplied tile by tile: a tile is a column and
two buckets of its documents, so no task multiplies out a whole column. The pairs that come of it are the mask, and only
for them overlap counts are accumulated over all entries indexed. A pair is discarded unless its count, with what
can still be shared behind the entries indexed, reaches the overlap that the two sizes need; the rest is counted on
whole sets.

A column drops the documents whose size no other of its documents comes near, and with them all columns of one document.
Columns of few documents are multiplied out at once. In the others each document first meets the column's leader; what
these links join is one component, and only pairs that are still in different components are multiplied out. No
component is lost that way, since a pair inside one changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NEAR_PERCENT, SHINGLE_WORDS, WordHashes, column, discard, shingle_hashes, slices, small_batches, stash
from .components import components

#: N-grams counted together in a task, and documents of such a count in which an n-gram is called common.
CHUNK_ENTRIES, COMMON_DOCS = 3_000_000, 3
#: Most n-grams that the order puts last; any choice of them keeps the join exact.
COMMON_ENTRIES = 500_000
#: Document ids that are broadcast to pick texts; beyond it they are picked by a shuffle.
BROADCAST_IDS = 2_000_000
#: Documents of a column that is multiplied out at once.
FEW_DOCS = 4
#: Rounds in which documents of larger columns meet leaders before the rest is multiplied out.
LEADER_ROUNDS = 2
#: Documents of a column in one bucket, on average.
BUCKET_DOCS = 500

SETS = "doc_id long, n long, sig binary, last long, rare int, entries array<long>"


def entries_of(texts: list[str | None], hashes: WordHashes, words: int) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct shingles."""
    return (np.unique(shingle_hashes(w, words)) for w in hashes.each(texts))


def least_shared(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def common_entries(docs: DataFrame, words: int) -> np.ndarray:
    """N-grams that several different sets of some chunk hold, the most frequent first up to COMMON_ENTRIES, sorted by hash.

    They only set the order of the n-grams, so they may be counted by chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[np.ndarray] = []
        seen: set[bytes] = set()

        def counted() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values.sort()
            # of a run of equal values, those with COMMON_DOCS - 1 equal ones behind them
            many = values[: 1 - COMMON_DOCS][values[COMMON_DOCS - 1 :] == values[: 1 - COMMON_DOCS]]
            del values
            many, more = np.unique(many, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(many.view(np.int64)), pa.array(more.astype(np.int64) + COMMON_DOCS - 1)], ["s", "c"])

        size = 0
        for b in slices(batches):
            for own in entries_of(column(b, "t"), hashes, words):
                sig = xxhash.xxh3_128_digest(own.tobytes())
                if sig in seen:
                    continue
                seen.add(sig)
                held.append(own)
                size += len(own)
                if size >= CHUNK_ENTRIES:
                    yield counted()
                    size = 0
                    seen.clear()
        if held:
            yield counted()

    counts = docs.select("t").mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "s").limit(COMMON_ENTRIES).select("s").toArrow()
    return np.sort(top.column("s").to_numpy().view(np.uint64))


def shingle_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """SETS: per row the size and digest of its set, and the entries that a partner must meet; for copies within a task only once.

    ``last`` is the place of the last of these entries in the order of n-grams; the first ``rare`` of them are not known as common.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_entries(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = WordHashes(), common.value
        bits = np.zeros(1 << 22, bool)
        bits[last >> np.uint64(42)] = True
        seen: set[bytes] = set()
        for b in slices(batches):
            sizes, sigs, lasts, rares, firsts = [], [], [], [], []
            for doc, own in zip(column(b, "d"), entries_of(column(b, "t"), hashes, words), strict=True):
                n = len(own)
                sizes.append(n)
                sig = xxhash.xxh3_128_digest(own.tobytes())
                sigs.append(sig)
                if not n or doc is None or sig in seen:
                    lasts.append(None)
                    rares.append(None)
                    firsts.append(None)
                    continue
                seen.add(sig)
                keep = n - least_shared(n, percent) + 1
                late = bits[own >> np.uint64(42)]
                if late.any():
                    some = own[late]
                    late[late] = last[np.searchsorted(last, some).clip(max=len(last) - 1)] == some
                early = own[~late][:keep]
                own = np.concatenate([early, own[late][: keep - len(early)]])
                lasts.append(int(own[-1]) >> 2 | (keep > len(early)) << 62)
                rares.append(len(early))
                firsts.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(lasts, pa.int64()), pa.array(rares, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], ["doc_id", "n", "sig", "last", "rare", "entries"])

    return stash(docs.mapInArrow(run, SETS), "sets")


def of_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``table`` whose doc_id is in ``ids``: few ids are sent to the rows, so that only these rows are shuffled on."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return table.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def ids_of(pairs: DataFrame) -> DataFrame:
    return stash(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")


def needed(percent: int):
    """The overlap that sets of na and nb entries need."""
    return F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))


def counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) left after their overlap counts over all indexed entries are held against the bound.

    Of two sets, take the one whose indexed entries end first in the order: the count has every shared entry up to there, and
    behind it this set has ceil(t n) - 1.
    """
    sets = of_ids(sets, ids_of(pairs))
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("last").alias(f"l{x}"), F.col("entries").alias(f"e{x}")) for x in "ab")
    rest = lambda x: F.ceil(F.col(f"n{x}") * percent / 100) - 1
    left = F.when(F.col("la") < F.col("lb"), rest("a")).when(F.col("lb") < F.col("la"), rest("b")).otherwise(F.greatest(rest("a"), rest("b")))
    enough = F.size(F.array_intersect("ea", "eb")) + left >= needed(percent)
    return stash(pairs.join(a, "a").join(b, "b").filter(enough).select("a", "b").distinct(), "counted")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 64):
            keep_a, keep_b = [], []
            ta, tb = column(batch, "ta"), column(batch, "tb")
            every = list(dict.fromkeys(ta + tb))
            own = dict(zip(every, entries_of(every, hashes, words), strict=True))
            for a, b, x, y in zip(column(batch, "a"), column(batch, "b"), map(own.get, ta), map(own.get, tb), strict=True):
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared and 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep_a.append(a)
                    keep_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], ["a", "b"])

    texts = of_ids(texts, ids_of(pairs))
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return stash(pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long"), "links")


def mixed(columns_: DataFrame, of: str = "comp") -> DataFrame:
    """``columns_`` (s, ``of``, ...) without columns of one value of ``of``, with the number ``c`` of a column's documents."""
    found = columns_.groupBy("s").agg(F.min(of).alias("lo"), F.max(of).alias("hi"), F.count(F.lit(1)).alias("c"))
    return columns_.join(found.filter("lo < hi").select("s", "c"), "s")


def mixed_rare(columns_: DataFrame, percent: int, of: str) -> DataFrame:
    """The same for n-grams not known as common, which few sets of any chunk hold, without documents that are alone in their size.

    Such a column fits in a task, so its documents move once and stand by size: if the next smaller and the next larger one are out
    of reach, all are.
    """
    by_size, whole = Window.partitionBy("s").orderBy("n"), Window.partitionBy("s")
    near = columns_.withColumn("less", F.lag("n").over(by_size)).withColumn("more", F.lead("n").over(by_size))
    near = near.filter((F.col("less") * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.col("more") * percent)).drop("less", "more")
    found = near.withColumn("lo", F.min(of).over(whole)).withColumn("hi", F.max(of).over(whole)).withColumn("c", F.count(F.lit(1)).over(whole))
    return found.filter("lo < hi").drop("lo", "hi")


def first_entries(indexed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The entries (s, i, doc_id, n, comp, c, held, last) of columns that hold several different sets, written.

    held: how many such columns the document has. Sets are told apart by a 64-bit hash, so that they need not move before their
    entries do. What belongs to a document, its component among it, joins the entries that are left; of the documents of one
    set only the first one goes on.
    """
    posted = indexed.withColumn("own", F.xxhash64("sig")).select(F.posexplode("entries").alias("i", "s"), "doc_id", "n", "own", "rare")
    rare, common = posted.filter("i < rare").drop("rare"), posted.filter("i >= rare").drop("rare")
    left = stash(mixed_rare(rare, percent, "own").unionByName(mixed(common, "own")).drop("own"), "mixed")
    held = left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("held"))
    first = indexed.groupBy("sig").agg(F.min(F.struct("doc_id", "n", "last")).alias("first")).select("first.*").distinct()
    # several texts of one id share their number of columns: more pairs, none lost
    out = stash(left.join(held.join(first, "doc_id").join(nodes, "doc_id"), ["doc_id", "n"]), "entries")
    discard(left)
    return out


def may_link(percent: int):
    """Whether sets a and b can be similar enough, by their sizes and by the columns that are left to them.

    Similar sets of x and y entries share t (x + y) / (1 + t) or more. Of two, take the one whose indexed entries end first in the
    order: each shared entry up to that place is among its ``held`` columns (counted before the first links, so never too few), and
    behind it there are ceil(t n) - 1.
    """
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    most = lambda x: F.col(f"h{x}") + F.ceil(F.col(f"n{x}") * percent / 100) - 1
    first = F.when(F.col("la") < F.col("lb"), most("a")).when(F.col("lb") < F.col("la"), most("b")).otherwise(F.greatest(most("a"), most("b")))
    return sizes & (first * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)


def _side(x: str) -> list:
    return [F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("held").alias(f"h{x}"), F.col("last").alias(f"l{x}"), F.col("comp").alias(f"c{x}")]


def leader_pairs(columns_: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each document with the leader of each of its columns, if they are apart. The leader is of the column's largest component."""
    key = F.col("doc_id") if turn == 0 else F.xxhash64("s", "doc_id", F.lit(turn))
    by_comp = columns_.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(key.alias("k"), "doc_id", "n", "held", "last")).alias("lead"))
    best = by_comp.groupBy("s").agg(F.max(F.struct("c", (-F.col("comp")).alias("o"), "lead")).alias("m"))
    best = best.select("s", "m.lead.*", (-F.col("m.o")).alias("comp")).select("s", *_side("b"))
    rows = columns_.select("s", *_side("a")).join(best, "s").filter("ca <> cb")
    return rows.filter(may_link(percent)).select("a", "b").distinct()


def product_pairs(columns_: DataFrame, percent: int, tiles: bool = True) -> DataFrame:
    """Pairs of different components that may be similar and meet in their first columns.

    For sizes x and y and the overlap o = ceil(t (x + y) / (1 + t)) that they need, these are the first x - o + 1 and y - o + 1
    entries: similar sets meet there. A tile is a column with a bucket of its rows and one of its other rows; columns of
    few documents are tiles as they are.
    """
    deal = [[], []]
    if tiles:
        buckets = F.ceil(F.col("c") / BUCKET_DOCS).cast("int")
        bucket, other = F.pmod(F.xxhash64("doc_id"), buckets).cast("int"), F.explode(F.sequence(F.lit(0), buckets - 1))
        deal = [[bucket.alias("u"), other.alias("v")], [bucket.alias("v"), other.alias("u")]]
    a = columns_.select("s", F.col("i").alias("ia"), *_side("a"), *deal[0])
    b = columns_.select("s", F.col("i").alias("ib"), *_side("b"), *deal[1])
    early = (F.col("ia") <= F.col("na") - needed(percent)) & (F.col("ib") <= F.col("nb") - needed(percent))
    met = a.join(b, ["s", "u", "v"] if tiles else "s")
    return met.filter((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & early & may_link(percent)).select("a", "b").distinct()


def merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, comp) after joining components by links between documents."""
    comp = nodes.select(F.col("doc_id").alias("a"), F.col("comp").alias("ca")), nodes.select(F.col("doc_id").alias("b"), F.col("comp").alias("cb"))
    edges = links.join(comp[0], "a").join(comp[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(edges).select(F.col("node").alias("comp"), "root")
    return stash(nodes.join(roots, "comp", "left").select("doc_id", F.coalesce("root", "comp").alias("comp")), "nodes")


def near_copies(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = NEAR_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    n_shingles is the number of distinct shingles (by 64-bit hash). component_id is the smallest doc_id that links reach; a link
    joins rows whose sets have a similarity of ``percent`` hundredths or more. Null and empty texts have no shingles
    and no links. Rows of equal id count as linked, whatever their texts, and each text has its own links; a null id has no
    links and a null component.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    sets = shingle_sets(rows, words, percent)
    full = sets.filter("n > 0 and doc_id is not null").select("doc_id", "sig")
    same = stash(full.groupBy("sig").agg(F.min("doc_id").alias("comp")), "same")
    known = full.join(same, "sig").groupBy("doc_id").agg(F.min("comp").alias("comp"), F.max("comp").alias("other"))
    known = stash(known, "nodes")
    nodes = known.select("doc_id", "comp")
    links = known.filter("comp < other").select("doc_id", F.col("comp").alias("a"))  # ids with texts of several components
    if not links.isEmpty():
        links = full.join(same, "sig").join(links, "doc_id").select("a", F.col("comp").alias("b")).filter("a <> b").distinct()
    else:
        links = links.select("a", F.col("doc_id").alias("b"))
    indexed = sets.filter("entries is not null and doc_id is not null")
    entries = first_entries(indexed, nodes, percent)
    texts = rows.select(F.col("d").alias("doc_id"), F.col("t").alias("text")).filter("t is not null")
    for turn in range(LEADER_ROUNDS + 1):
        many = entries.filter(F.col("c") > FEW_DOCS) if turn == 0 else entries
        pairs = leader_pairs(many, turn, percent) if turn < LEADER_ROUNDS else product_pairs(many, percent)
        if turn == 0:
            pairs = pairs.unionByName(product_pairs(entries.filter(F.col("c") <= FEW_DOCS), percent, tiles=False))
        pairs = stash(pairs, "pairs")
        left = counted(pairs, indexed, percent)
        found = verified(left, texts, words, percent)
        discard(pairs, left)
        nodes = merged(nodes, found if turn else found.unionByName(links))
        if turn < LEADER_ROUNDS:
            before, entries = entries, stash(mixed(many.drop("comp", "c").join(nodes, "doc_id")), "entries")
            discard(before)
            if entries.isEmpty():
                break
    final = nodes.select(F.col("doc_id").alias("k"), F.col("comp").alias("component_id"))
    return sets.join(final, sets["doc_id"] == final["k"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` but for those with a near copy of a smaller id: one id stays of each component. Null ids stay."""
    found = near_copies(docs, id_col=id_col, **options)
    drop = stash(found.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("copy_id")).distinct(), "copies")
    few = drop.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(drop) if few else drop, docs[id_col] == drop["copy_id"], "left_anti")
