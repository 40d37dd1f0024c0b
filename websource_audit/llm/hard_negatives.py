"""Hard negatives of anchors: Hilbert-ordered blocks of candidates with zone maps, read only where interval arithmetic asks for it.

Candidates are sorted by label and by their place on a Hilbert curve through the space of their components, and written as
blocks of BLOCK rows with the least and largest value of each component and label. For an anchor a and a block, the scores of
all its rows lie between the sums over the components of the smaller and of the larger one of a * low and a * high. A
window (a range of scores, for one anchor) must read a block only if these intervals meet, and if blocks that lie
wholly within the window and above this one do not hold enough rows for its whole answer.

There are two rounds of windows: all scores among rows of the anchor's label, for its positives, then one range of scores for
each positive among the rows of other labels. Anchors go in batches, zone maps in pages and blocks in groups, so a task holds one
batch, and one page of zone maps or one block, whatever the size of the table; answers of groups are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Rows of a block, anchors of a batch, zone maps of a page, blocks of a group.
BLOCK, BATCH, PAGE, GROUP = 256, 512, 1024, 64
#: Bits of each component that place a row on the Hilbert curve.
CURVE_BITS = 2
ANCHOR_EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score is between these hundredths of the positive's.
LEAST_PERCENT, MOST_PERCENT = 30, 90

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
PACKED = "block long, n int, lows array<long>, highs array<long>, label_low int, label_high int, ids binary, labels binary, vectors binary"
FOUND = "batch long, anchor_id long, positive_id long, positive_score long, score long, id long"


def quantized(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v) of the rows that take part: v = floor(256 * component), labels shifted where the id is a multiple of 7.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Of rows of one id the
    least (label, v) does.
    """
    r = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("x"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    r = r.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & good)
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    out = r.select("id", label.alias("label"), F.transform("x", lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("v"))
    if out.select("id").groupBy("id").count().filter("count > 1").isEmpty():
        return out
    return out.groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")


def curve_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """The places of points with coordinates below 2**bits (rows of ``cells``) on a Hilbert curve, as keys that sort in its order."""
    x = cells.astype(np.uint32).copy()
    d = x.shape[1]
    level = 1 << bits - 1
    while level > 1:
        low = np.uint32(level - 1)
        for k in range(d):
            high = (x[:, k] & level) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, k]) & low)
            x[:, 0] ^= np.where(high, low, swap).astype(np.uint32)
            x[:, k] ^= swap.astype(np.uint32)
        level >>= 1
    x = np.bitwise_xor.accumulate(x, axis=1)
    turn = np.zeros(len(x), np.uint32)
    level = 1 << bits - 1
    while level > 1:
        turn ^= np.where(x[:, -1] & level, level - 1, 0).astype(np.uint32)
        level >>= 1
    x ^= turn[:, None]
    planes = np.stack([x >> np.uint32(b) & 1 for b in reversed(range(bits))], axis=1).reshape(len(x), -1)
    return [r.tobytes() for r in np.packbits(planes.astype(np.uint8), axis=1)]


def _matrix(lists: pa.ListArray, d: int) -> np.ndarray:
    """Vectors as rows of d numbers, shorter ones filled with zeros."""
    out = np.zeros((len(lists), d), np.int64)
    size = np.diff(lists.offsets.to_numpy())
    out[np.arange(d)[None, :] < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def on_curve(rows: DataFrame, d: int, low: int, high: int) -> DataFrame:
    """``rows`` (id, label, v) with their key on the curve; components lie between ``low`` and ``high``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share = (_matrix(b.column("v"), d).astype(np.float64) - low) / (float(high) - low + 1)
            cells = (share * (1 << CURVE_BITS)).astype(np.int64).clip(0, (1 << CURVE_BITS) - 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("v"), pa.array(curve_keys(cells), pa.binary())], ["id", "label", "v", "key"])

    return rows.mapInArrow(run, "id long, label int, v array<long>, key binary")


def packed(rows: DataFrame, d: int, size: int) -> DataFrame:
    """PACKED blocks of ``size`` rows in the order of label, curve and id, with their zone maps. Their numbers hold once it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def block(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> dict:
            small = v.min() >= -(1 << 31) and v.max() < 1 << 31
            return {"block": number, "n": len(ids), "lows": v.min(axis=0), "highs": v.max(axis=0), "label_low": labels.min(), "label_high": labels.max(), "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": v.astype(np.int32 if small else np.int64).tobytes()}

        schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("lows", pa.list_(pa.int64())), ("highs", pa.list_(pa.int64())), ("label_low", pa.int32()), ("label_high", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
        for b in batches:
            held.append((b.column("id").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("v"), d)))
            if sum(len(x[0]) for x in held) < size:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            for k in range(0, len(whole[0]) - size + 1, size):
                yield pa.RecordBatch.from_pylist([block(*(x[k : k + size] for x in whole))], schema)
                number += 1
            held = [tuple(x[len(whole[0]) // size * size :] for x in whole)]
        if held and sum(len(x[0]) for x in held):
            yield pa.RecordBatch.from_pylist([block(*(np.concatenate(x) for x in zip(*held, strict=True)))], schema)

    ordered = rows.repartitionByRange("label", "key", "id").sortWithinPartitions("label", "key", "id")
    return ordered.select("id", "label", "v").mapInArrow(run, PACKED)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products of the rows of a and b are exact as doubles."""
    return _largest(a) * _largest(b) * max(1, a.shape[1]) < 1 << 53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact; beyond 64 bits the least or largest long."""
    if _exact(a, b):
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return (a.astype(object) @ b.T.astype(object)).clip(LEAST, MOST).astype(np.int64)


class Anchors:
    """A batch of anchors and their windows: arrays ``of`` (anchor), ``low`` and ``high`` (scores), ``positive`` and ``ps``."""

    def __init__(self, row: dict, d: int, same: bool) -> None:
        self.batch, self.same = row["batch"], same
        self.ids, self.labels, self.v = unpacked(row, d)
        if same:
            n = len(self.ids)
            self.of, self.low, self.high = np.arange(n), np.full(n, LEAST), np.full(n, MOST)
            self.positive = self.ps = np.zeros(n, np.int64)
        else:
            place = {x: k for k, x in enumerate(self.ids.tolist())}
            given = [(place[w["anchor_id"]], w["positive_id"], w["positive_score"]) for w in row["windows"]]
            given = [(k, p, s, -(-s * LEAST_PERCENT // 100), s * MOST_PERCENT // 100) for k, p, s in given if s >= 0]
            self.of, self.positive, self.ps, self.low, self.high = np.array(given, np.int64).reshape(-1, 5).T
        self.k = POSITIVES if same else NEGATIVES
        self.label = self.labels[self.of]

    def bounds(self, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest possible score (window x block) with rows of the blocks that these zone maps belong to."""
        if not (_exact(self.v, lows) and _exact(self.v, highs)):
            return np.full((len(self.of), len(lows)), LEAST), np.full((len(self.of), len(lows)), MOST)
        up, down = self.v.clip(0).astype(np.float64), self.v.clip(None, 0).astype(np.float64)
        least, most = up @ lows.T + down @ highs.T, up @ highs.T + down @ lows.T
        return least.astype(np.int64)[self.of], most.astype(np.int64)[self.of]

    def wanted(self, n: np.ndarray, lows: np.ndarray, highs: np.ndarray, label_low: np.ndarray, label_high: np.ndarray) -> np.ndarray:
        """Which blocks of a page each window must read (window x block)."""
        least, most = self.bounds(lows, highs)
        label = self.label[:, None]
        alike, apart = (label_low == label) & (label_high == label), (label_low > label) | (label_high < label)
        meets = (label_low <= label) & (label <= label_high) if self.same else ~alike
        need = meets & (most >= self.low[:, None]) & (least <= self.high[:, None])
        # rows of blocks wholly in the window, by their least score: from k of them on, blocks below are not read
        sure = need & (alike if self.same else apart) & (least >= self.low[:, None]) & (most <= self.high[:, None])
        for w in np.flatnonzero(sure.any(axis=1)):
            own = np.flatnonzero(sure[w])
            own = own[np.argsort(-least[w, own], kind="stable")]
            enough = np.flatnonzero(np.cumsum(n[own]) >= self.k + 1)  # one may be the anchor itself
            if len(enough):
                need[w] &= most[w] >= least[w, own[enough[0]]]
        return need


def unpacked(row: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, raw = np.frombuffer(row["ids"], np.int64), row["vectors"]
    width = len(raw) // max(1, len(ids) * d)
    return ids, np.frombuffer(row["labels"], np.int32), np.frombuffer(raw, np.int32 if width == 4 else np.int64).reshape(len(ids), d)


class Best:
    """The first k rows of each window so far, by score from high to low, then by id."""

    def __init__(self, anchors: Anchors) -> None:
        self.a = anchors
        shape = (len(anchors.of), anchors.k)
        self.score, self.id, self.set = np.full(shape, LEAST), np.full(shape, MOST), np.zeros(shape, bool)

    def add(self, row: dict, d: int) -> None:
        a = self.a
        zone = (np.array([row[x]], np.int64) for x in ("lows", "highs"))
        least, most = (x[:, 0] for x in a.bounds(*zone))
        w = np.flatnonzero((most >= a.low) & (least <= a.high) & (~self.set[:, -1] | (most >= self.score[:, -1])))
        if not len(w):
            return
        ids, labels, v = unpacked(row, d)
        own, place = np.unique(a.of[w], return_inverse=True)
        s = products(a.v[own], v)[place]
        ok = (s >= a.low[w, None]) & (s <= a.high[w, None])
        ok &= (labels == a.label[w, None]) & (ids != a.ids[a.of[w], None]) if a.same else labels != a.label[w, None]
        ok &= ~self.set[w, -1:] | (s >= self.score[w, -1:])
        some = ok.any(axis=1)
        w, s, ok = w[some], s[some], ok[some]
        score = np.concatenate([self.score[w], s], axis=1)
        own_id = np.concatenate([self.id[w], np.broadcast_to(ids, s.shape)], axis=1)
        there = np.concatenate([self.set[w], ok], axis=1)
        first = np.lexsort((own_id, ~score, ~there), axis=1)[:, : a.k]  # ~ turns the order round without overflow
        self.score[w], self.id[w], self.set[w] = (np.take_along_axis(x, first, 1) for x in (score, own_id, there))

    def rows(self) -> pa.RecordBatch:
        a = self.a
        w, k = np.nonzero(self.set)
        columns = [np.full(len(w), a.batch), a.ids[a.of[w]], a.positive[w], a.ps[w], self.score[w, k], self.id[w, k]]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["batch", "anchor_id", "positive_id", "positive_score", "score", "id"])


def chosen(batches: DataFrame, zones: DataFrame, d: int, same: bool) -> DataFrame:
    """(batch, g, block, most): the blocks that each batch must read, in groups, with the largest score they may have."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        anchors, page, groups = None, None, 0

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal groups
            if not held or anchors is None or not len(anchors.of):
                return
            cols = {x: np.array([z[x] for z in held]) for x in ("n", "lows", "highs", "label_low", "label_high")}
            need = anchors.wanted(**cols)
            most = np.where(need, anchors.bounds(cols["lows"], cols["highs"])[1], LEAST).max(axis=0)
            ks = sorted(np.flatnonzero(need.any(axis=0)).tolist(), key=lambda k: -int(most[k]))
            out = {"batch": [anchors.batch] * len(ks), "g": [(page << 32) + groups + i // GROUP for i in range(len(ks))], "block": [held[k]["block"] for k in ks], "most": [int(most[k]) for k in ks]}
            groups += -(-len(ks) // GROUP)
            yield pa.RecordBatch.from_pydict(out, pa.schema([(x, pa.int64()) for x in out]))

        for b in parts:
            for row in b.to_pylist():
                if row["kind"] == 0 or len(held) == PAGE:
                    yield from answer()
                    held.clear()
                if row["kind"] == 0:
                    anchors, page, groups = Anchors(row, d, same), row["page"], 0
                else:
                    assert (row["batch"], row["page"]) == (anchors.batch, page)
                    held.append(row)
        yield from answer()

    pages = F.lit(-(-max(1, zones.count()) // PAGE)).cast("long")
    z = zones.select("block", "n", "lows", "highs", "label_low", "label_high", F.pmod(F.xxhash64("block"), pages).alias("page"))
    numbers = batches.select("batch", F.explode(F.sequence(F.lit(0).cast("long"), pages - 1)).alias("page"))
    a = batches.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), pages - 1))).withColumn("kind", F.lit(0))
    both = a.unionByName(numbers.join(z, "page").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("batch", "page").sortWithinPartitions("batch", "page", "kind").mapInArrow(run, "batch long, g long, block long, most long")


def read(batches: DataFrame, blocks: DataFrame, wanted: DataFrame, d: int, same: bool) -> DataFrame:
    """FOUND rows: for each window of each batch the first rows of each group of blocks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = None, None
        for b in parts:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                if row["kind"] == 0:
                    if best is not None:
                        yield best.rows()
                    best, at = Best(Anchors(row, d, same)), (row["batch"], row["g"])
                else:
                    assert at == (row["batch"], row["g"])
                    best.add(row, d)
        if best is not None:
            yield best.rows()

    tasks = wanted.select("batch", "g").distinct()
    a = tasks.join(batches, "batch").withColumn("kind", F.lit(0))
    rows = wanted.join(blocks.drop("n", "label_low", "label_high"), "block").withColumn("kind", F.lit(1)).drop("block")
    both = a.unionByName(rows, allowMissingColumns=True)
    return both.repartition("batch", "g").sortWithinPartitions("batch", "g", "kind", F.desc("most")).mapInArrow(run, FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first NEGATIVES of each anchor and positive.

    Anchors are rows whose id is divisible by ANCHOR_EVERY, or those where ``anchors``, a condition on ``id``, holds. See
    ``quantized`` for the rows that take part. Vectors of different lengths are compared as if filled with zeros. Ties go to the
    smaller id. An anchor alone in its label has no positives and no rows; where no row is in a window, the
    pair has no rows. Scores beyond 64 bits count as the least or largest long. An empty table gives an empty one; other columns take no part.
    """
    q = quantized(rows, id_col, vector_col, label_col)
    d, low, high = q.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    d = max(1, d or 1)
    placed = stash(on_curve(q, d, low or 0, high or 0), "placed")
    blocks = stash(packed(placed, d, BLOCK), "blocks")
    is_anchor = anchors if anchors is not None else F.col("id") % ANCHOR_EVERY == 0
    batches = stash(packed(placed.filter(is_anchor), d, BATCH).select(F.col("block").alias("batch"), "ids", "labels", "vectors"), "batches")
    positives = stash(_first(read(batches, blocks, stash(chosen(batches, blocks, d, True), "chosen"), d, True), ["anchor_id"], POSITIVES), "positives")
    pair = F.struct("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = batches.join(positives.groupBy("batch").agg(F.collect_list(pair).alias("windows")), "batch")
    windows = stash(windows, "windows")
    found = read(windows, blocks, stash(chosen(windows, blocks, d, False), "chosen"), d, False)
    first = _first(found, ["anchor_id", "positive_id"], NEGATIVES)
    return first.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
