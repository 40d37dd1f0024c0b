"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are partitioned by the size of their shingle set, and each partition has an index of its own. An item's sketch is its
k smallest shingle hashes (a bottom-k MinHash), with k set by the partition so that any text holding the wanted share of
the item's shingles holds at least one of them: of n shingles with at least ceil(t n) present, one of any
n - ceil(t n) + 1 is present. A text is probed partition by partition with its own smallest hashes, as far up as the
partition's sketches reach. So the search loses nothing, and each hit is then counted exactly on the words themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEAR_PERCENT, SHINGLE_WORDS, WordHashes, column, shingle_hashes, slices, small_batches, words_of

#: Benchmark items, and bytes of them, searched for in one pass over the documents. They bound what is sent to each task; larger benchmarks take more passes.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32_000_000
HITS = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def need(n: int, percent: int) -> int:
    """Shingles of n that must be present."""
    return -(-n * percent // 100)


def partition_of(n: int) -> int:
    """The size partition of a set of n shingles: the power of two that it reaches up to."""
    return 1 << max(0, int(n - 1).bit_length())


def sketch_size(partition: int, percent: int) -> int:
    """Hashes in the sketches of a partition: so many that a text which holds enough of any of its items holds one of them."""
    return partition - need(partition, percent) + 1


def sets_of(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """The distinct n-word shingles themselves."""
    if not words:
        return set()
    width = min(n, len(words))
    return set(zip(*(words[k : len(words) - width + 1 + k] for k in range(width)), strict=True))


class Partition:
    """The sketches of the items of one size partition: which items hold a value, and the largest value of all sketches.

    A text's sketch for the partition is its hashes up to that value; only these are looked up.
    """

    def __init__(self, sketches: list[tuple[int, np.ndarray]]) -> None:
        by: dict[int, list[int]] = defaultdict(list)
        for item, values in sketches:
            for h in values.tolist():
                by[h].append(item)
        self.by = dict(by)
        self.values = np.array(sorted(by), np.uint64)
        self.top = self.values[-1]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.values >> np.uint64(44)] = True

    def met(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that some sketch holds."""
        own = np.flatnonzero(hashes <= self.top)
        own = own[self.bits[hashes[own] >> np.uint64(44)]]
        return own[np.isin(hashes[own], self.values)] if len(own) else own


class Index:
    """A block of items, by size partition."""

    def __init__(self, items: list[tuple[int, str]], percent: int, n: int) -> None:
        self.items, self.percent, self.n = items, percent, n
        self.sets: dict[int, set] = {}
        parts: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for k, words in enumerate(WordHashes().each([t for _, t in items])):
            hashes = np.unique(shingle_hashes(words, n))
            if len(hashes):
                part = partition_of(len(hashes))
                parts[part].append((k, hashes[: sketch_size(part, percent)]))
        self.parts = [Partition(parts[p]) for p in sorted(parts)]

    def candidates(self, hashes: list[np.ndarray]) -> dict[int, set[int]]:
        """By place of the text in ``hashes`` (one array for each), the items that one of its hashes leads to."""
        ends, flat = np.cumsum([len(h) for h in hashes]), np.concatenate(hashes)
        out: dict[int, set[int]] = {}
        for part in self.parts:
            at = part.met(flat)
            for k, h in zip(np.searchsorted(ends, at, "right").tolist(), flat[at].tolist(), strict=True):
                out.setdefault(k, set()).update(part.by[h])
        return out

    def shared(self, item: int, own: set) -> tuple[int, int] | None:
        """(the item's shingles, those in the text) if these are enough."""
        if item not in self.sets:
            self.sets[item] = sets_of(words_of(self.items[item][1]), self.n)
        wanted = self.sets[item]
        n = len(wanted & own)
        return (len(wanted), n) if n >= need(len(wanted), self.percent) else None


def contained_items(docs: DataFrame, items: DataFrame, percent: int = NEAR_PERCENT, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item of which it holds at least ``percent`` hundredths of the distinct shingles.

    Columns: doc_id, item_id, n_item, n_shared, containment. Null and empty texts on either side match nothing; an item
    of fewer words than a shingle matches only a text of just those words. Rows with a null item id are passed over;
    repeated documents give repeated rows, equal items count once, and texts that share an item id are items of their
    own: a document has a row for each that it holds. Other columns are not read.
    """
    spark = docs.sparkSession
    bench = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).filter("i is not null and t is not null").distinct()
    size = bench.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-size.b // BLOCK_BYTES))
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).filter("t is not null")

    def search(k: int) -> DataFrame:
        block = bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        index = spark.sparkContext.broadcast([(r.i, r.t) for r in block])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, words = Index(index.value, percent, shingle_words), WordHashes()
            for b in slices(batches, 64):
                ids, own = column(b, "d"), column(b, "t")
                rows = []
                for k, near in sorted(found.candidates([shingle_hashes(w, shingle_words) for w in words.each(own)]).items()):
                    held = sets_of(words_of(own[k]), shingle_words)
                    for item in sorted(near):
                        if got := found.shared(item, held):
                            rows.append((ids[k], found.items[item][0], *got, got[1] / got[0]))
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

        return texts.mapInArrow(run, HITS)

    out = search(0)
    for k in range(1, blocks):
        out = out.unionByName(search(k))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item; rows with a null id stay."""
    hits = contained_items(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hits, docs[id_col] == hits["hit_id"], "left_anti")
