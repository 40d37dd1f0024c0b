"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is its histogram of at most ``capacity`` counts, however
many documents there are. The plan made from it holds groups of equal sequences, not single ones, and is bounded
by the capacity as well. Tasks then place each piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import token_ids, column, slices, small_batches, stash

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut at the capacity where longer.

    Null and empty texts are the end id alone; repeated rows give repeated pieces; a null id stays null. ``rank``
    counts the pieces of equal length within the task ``task``. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = token_ids(tokenizer_path), np.uint32(END_ID).astype("<u4").tobytes()
        seen: dict[int, int] = defaultdict(int)
        task = TaskContext.get().partitionId()
        for b in slices(batches):
            rows = []
            for doc, text in zip(column(b, "d"), column(b, "t"), strict=True):
                own = ids.of(text) + end
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(run, PIECES)


class Plan:
    """Groups of equal sequences: (how many, ((length, how often), ...))."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.groups = capacity, []

    def fix(self, times: int, items: tuple[tuple[int, int], ...]) -> None:
        if times:
            self.groups.append((times, items))


def reduce_by_dominance(counts: dict[int, int], plan: Plan) -> dict[int, int]:
    """Fix the sets that dominate every other set holding their item a; return the counts left.

    b is the largest other item that fits beside a. Every length is tried, the largest first, until none can be fixed:

    - {a} where not even the smallest other item fits;
    - {a, b} with a + b = capacity: what another set holds beside a fits in the place of b;
    - {a, b} where no two items fit: another set has one item there, at most b;
    - {a, b, d}, d the largest that fits beside a and b, where no three items fit, and no two that are both larger than d:
      another set has two items there, one at most b, the other at most d.
    """
    c = plan.capacity
    left = {k: n for k, n in counts.items() if n}
    sizes = sorted(left)

    def largest(room: int, taken: tuple[int, ...]) -> int | None:
        """The largest item of at most ``room`` beside those ``taken``."""
        k = bisect.bisect_right(sizes, room) - 1
        while k >= 0 and left[sizes[k]] <= taken.count(sizes[k]):
            k -= 1
        return sizes[k] if k >= 0 else None

    def smallest(a: int, n: int, above: int = 0) -> int:
        """The sum of the n smallest items but one a that are larger than ``above``; beyond any room if there are fewer."""
        total = 0
        for k in range(bisect.bisect_right(sizes, above), len(sizes)):
            take = min(n, left[sizes[k]] - (sizes[k] == a))
            total, n = total + take * sizes[k], n - take
            if not n:
                return total
        return c + 1

    def dominating(a: int) -> tuple[int, ...] | None:
        room = c - a
        b = largest(room, (a,))
        if b is None:
            return (a,)
        if b == room or smallest(a, 2) > room:
            return (a, b)
        d = largest(room - b, (a, b))
        return (a, b, d) if d is not None and smallest(a, 3) > room and smallest(a, 2, d) > room else None

    fixed = True
    while fixed:
        fixed = False
        for a in reversed(sizes.copy()):
            while a in left and (found := dominating(a)):
                items = tuple((x, found.count(x)) for x in dict.fromkeys(found))
                n = min(left[x] // k for x, k in items)
                plan.fix(n, items)
                fixed = True
                for x, k in items:
                    left[x] -= n * k
                    if not left[x]:
                        del left[x]
                        sizes.remove(x)
    return left


def best_fit(counts: dict[int, int], plan: Plan) -> None:
    """Best-fit decreasing on counts: the items of a length go to the tightest open sequences, then to new ones."""
    c = plan.capacity
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, times: int, items: tuple[tuple[int, int], ...]) -> None:
        if not times:
            return
        if not room:
            plan.fix(times, items)
            return
        if not open_[room]:
            bisect.insort(rooms, room)
        open_[room].append((times, items))

    for a in sorted(counts, reverse=True):
        n = counts[a]
        while n:
            k = bisect.bisect_left(rooms, a)
            if k == len(rooms):
                room, times, items = c, -(-n // (c // a)), ()
            else:
                room = rooms[k]
                times, items = open_[room].pop()
                if not open_[room]:
                    rooms.pop(k)
            each = room // a
            full = min(times, n // each)
            n -= full * each
            put(room - each * a, full, (*items, (a, each)))
            rest = times - full
            if rest and n:
                put(room - n * a, 1, (*items, (a, n)))
                n, rest = 0, rest - 1
            if items:
                put(room, rest, items)
    for room in list(rooms):
        for times, items in open_[room]:
            plan.fix(times, items)


class Places:
    """Looks up where the piece of a given length and rank goes. Its size is bounded by the capacity, not by the input."""

    def __init__(self, plan: Plan) -> None:
        by: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        self.sequences = 0
        for times, items in plan.groups:
            at = 0
            for size, each in items:
                by[size].append((used[size], self.sequences, at, each))
                used[size] += times * each
                at += size * each
            self.sequences += times
        self.by = {size: np.array(rows, np.int64) for size, rows in by.items()}

    def of(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.by[size]
        row = rows[np.searchsorted(rows[:, 0], ranks, "right") - 1]
        copy, nth = np.divmod(ranks - row[:, 0], row[:, 3])
        return row[:, 1] + copy, row[:, 2] + nth * size


def plan_of(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(capacity)
    best_fit(reduce_by_dominance(counts, plan), plan)
    return plan


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Pieces with the sequence and offset where each goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences are filled without gaps from offset 0. Ties (pieces of equal length) go by task and row order. No
    documents, no rows.
    """
    pieces = stash(token_pieces(docs, capacity, id_col, text_col, tokenizer_path), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    by_task = stash(by_task.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "ranks")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = docs.sparkSession.sparkContext.broadcast(Places(plan_of(counts, capacity)))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            seq, at = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if len(own):
                    seq[own], at[own] = places.value.of(int(size[own[0]]), rank[own])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(at)], [*names, "sequence_id", "offset"])

    # by a shuffle of these short rows: the counts by length and task grow with the number of tasks
    return pieces.join(by_task.drop("n").hint("merge"), ["length", "task"]).mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
