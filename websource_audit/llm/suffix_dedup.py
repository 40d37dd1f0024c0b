"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Only sampled suffixes are sorted. Each window of LENGTH bytes is anchored at its smallest gram of GRAM bytes (by a hash,
leftmost first), so equal windows have equal anchors at equal places: no repeat is lost, and some 3 in 100 positions are
anchors. Anchors whose gram occurs once are dropped. Tasks sort the suffixes of the others into front-coded runs, which are
exchanged by gram; a loser tree merges them and never compares again what the common prefixes already say. Among
the merged suffixes of one gram, what stands before each is compared too, which gives the exact windows that also start
earlier.

A gram that is too frequent for one task (a common line between differing neighbours) has no such group: its windows go
out by digest, each once a task, and the first of each digest is found by a partially aggregated minimum.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices, stash

#: Bytes of a repeat, of an anchor gram, and the grams in a window.
LENGTH, GRAM = 100, 30
GRAMS = LENGTH - GRAM + 1
#: Contexts that a task holds before it writes its runs, and contexts of a part that are merged in one task on average.
RUN_CONTEXTS, PART_CONTEXTS = 200_000, 8_000
#: Occurrences of a gram up to which its contexts are merged in one task; the windows of more frequent ones are grouped by digest.
HOT_GRAM = 20_000
#: Contexts of frequent grams whose windows a task holds at once.
HOT_CONTEXTS = 4_000
#: Distinct contexts of a gram up to which they are compared in pairs; more are compared window by window.
PAIRWISE = 12
#: Ids of whole copies that are broadcast; beyond it they meet the documents by a shuffle.
BROADCAST_IDS = 2_000_000
#: Windows of a long text that are looked at together.
SEGMENT = 1 << 20

_POS_BITS = np.uint64(28)
_POS = np.uint64((1 << 28) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_HEAD = struct.Struct("<BBBBqq")


class Grams:
    """Hashes of all grams of a byte string: a polynomial modulo 2**64 over random byte values, from running sums."""

    def __init__(self) -> None:
        self.values = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]

    def of(self, data: np.ndarray, width: int) -> np.ndarray:
        up, down = self.powers(len(data))
        sums = np.cumsum(self.values[data] * down, dtype=np.uint64)
        out = sums[width - 1 :].copy()
        out[1:] -= sums[:-width]
        out *= up[width - 1 :]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each run of ``width``, from running minima of blocks in both directions."""
    n = len(x)
    blocks = np.full((-(-n // width), width), np.iinfo(np.uint64).max, np.uint64)
    blocks.ravel()[:n] = x
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, grams: Grams, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first window, last window) of each anchor; windows of one anchor are consecutive.

    A text of more than ``segment`` windows is taken in segments; an anchor whose windows lie in two of them is given twice.
    """
    if len(data) >= segment + LENGTH:
        parts = []
        for at in range(0, len(data) - LENGTH + 1, segment):
            g, *places = anchors(data[at : at + segment + LENGTH - 1], grams, segment)
            parts.append((g, *(x + at for x in places)))
        return tuple(map(np.concatenate, zip(*parts, strict=True)))
    if len(data) < LENGTH:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    g = grams.of(data, GRAM)
    least = sliding_min(g & ~_POS | np.arange(len(g), dtype=np.uint64) & _POS, GRAMS)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    place = (least[first] & _POS).astype(np.int64)
    return g[place], place, first, last


def lcp(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def write_run(items: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of (suffix, before, doc, first window, windows), front-coded: each suffix without what it shares with the one before."""
    out, last = bytearray(), b""
    for suffix, before, doc, first, windows in items:
        n = lcp(last, suffix)
        out += _HEAD.pack(n, len(suffix) - n, len(before), windows, doc, first)
        out += suffix[n:]
        out += before
        last = suffix
    return bytes(out)


def read_run(blob: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, int, int, int]]]:
    """(common prefix with the item before, suffix, (before, doc, first window, windows))."""
    at, last = 0, b""
    while at < len(blob):
        n, rest, left, windows, doc, first = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        last = last[:n] + blob[at : at + rest]
        at += rest
        yield n, last, (blob[at : at + left], doc, first, windows)
        at += left


def merge_runs(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """All items in order, each with its common prefix with the one before: a loser tree over common prefixes.

    Each player knows its common prefix with the last winner. Of two, the longer prefix wins without a look at the
    suffixes; only equal ones are compared, from that prefix on, and the loser keeps what it shares with the winner.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    end = (-1, b"", None)
    items = [next(r, end) for r in runs] + [end] * (size - len(runs))
    known = [x[0] if x[2] is None else 0 for x in items]
    tree = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        sa, sb = items[a][1], items[b][1]
        n = lcp(sa, sb, ka)
        if sa[n : n + 1] <= sb[n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        now = []
        for k in range(level):
            win, lose = play(winners[2 * k], winners[2 * k + 1])
            tree[level + k] = lose
            now.append(win)
        winners = now
    win = winners[0]
    while known[win] >= 0:
        shared, (_, suffix, more) = known[win], items[win]
        yield shared, suffix, more
        items[win] = next(runs[win], end)
        known[win] = items[win][0]
        node = (win + size) // 2
        while node:
            win, tree[node] = play(win, tree[node])
            node //= 2


def repeated_windows(group: list[tuple[bytes, tuple[bytes, int, int, int]]], pairwise: int = PAIRWISE) -> Iterator[tuple[int, int, int]]:
    """(doc, first, last) windows that also start earlier, from the suffixes of one gram with what stands before each."""
    group = sorted(group, key=lambda x: (x[1][1], x[1][2] + len(x[1][0])))
    distinct: dict[tuple[bytes, bytes], None] = {}
    own = []
    for suffix, (before, doc, first, windows) in group:
        if (suffix, before) in distinct:
            yield doc, first, first + windows - 1
        else:
            distinct[suffix, before] = None
            own.append((suffix, before, before[::-1], doc, first, windows))
    if len(own) <= pairwise:
        for i, (suffix, before, back, doc, first, windows) in enumerate(own):
            place = first + len(before)
            for s, _, b, *_ in own[:i]:
                left, right = lcp(back, b), lcp(suffix, s)
                if left + right >= LENGTH:
                    yield doc, place - left, min(place - LENGTH + right, first + windows - 1)
        return
    # window by window: equal windows are found by hash, then held against their first one byte by byte
    wide = GRAMS - 1
    m = np.zeros((len(own), wide + LENGTH), np.uint8)
    for i, (suffix, before, *_) in enumerate(own):
        m[i, wide - len(before) : wide + len(suffix)] = np.frombuffer(before + suffix, np.uint8)
    top = np.array([len(x[1]) for x in own])
    low = top - np.array([x[5] for x in own]) + 1
    doc, place = [x[3] for x in own], [x[4] + len(x[1]) for x in own]
    weights = np.random.default_rng(7).integers(0, 1 << 63, LENGTH, np.uint64) * np.uint64(2) + np.uint64(1)
    for d in range(int(low.min()), int(top.max()) + 1):
        rows = np.flatnonzero((low <= d) & (d <= top))
        part = m[rows, wide - d : wide - d + LENGTH]
        mark = (part.astype(np.uint64) * weights).sum(1, dtype=np.uint64)
        _, head, back_ = np.unique(mark, return_index=True, return_inverse=True)
        if (part != part[head[back_]]).any():
            _, head, back_ = np.unique(np.ascontiguousarray(part).view(f"V{LENGTH}").ravel(), return_index=True, return_inverse=True)
        for i in rows[head[back_] != np.arange(len(rows))].tolist():
            yield doc[i], place[i] - d, place[i] - d


def joined_intervals(windows: list[tuple[int, int, int]]) -> dict[int, bytes]:
    """By document, the bytes covered by windows, as ascending (from, to) pairs of little-endian longs."""
    out: dict[int, bytes] = {}
    by: dict[int, list[tuple[int, int]]] = {}
    for doc, first, last in windows:
        by.setdefault(doc, []).append((first, last + LENGTH))
    for doc, spans in by.items():
        spans.sort()
        flat = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= flat[-1][1]:
                flat[-1][1] = max(flat[-1][1], b)
            else:
                flat.append([a, b])
        out[doc] = np.array(flat, "<i8").tobytes()
    return out


def _gram_rows(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in slices(batches):
            docs, hashes, times = [], [], []
            for doc, text in zip(column(b, "doc_id"), column(b, "t"), strict=True):
                g, c = np.unique(anchors(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8), grams, segment)[0], return_counts=True)
                times.append(c)
                docs.append(np.full(len(g), doc, np.int64))
                hashes.append(g.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(times), pa.int64())], ["g", "doc_id", "c"])

    return run


def distinct_windows(contexts: list[tuple[bytes, int, int, int]], repeats: list[tuple[int, int, int]]) -> dict[bytes, tuple[int, int]]:
    """The first (doc, start) of each window of (bytes, doc, first window, windows) by its digest; the others are added to ``repeats``."""
    held: dict[bytes, tuple[int, int]] = {}
    for context, doc, first, windows in contexts:
        for k in range(windows):
            key, mine = hashlib.blake2b(context[k : k + LENGTH], digest_size=16).digest(), (doc, first + k)
            other = held.setdefault(key, mine)
            if other is mine or other == mine:
                continue
            if mine < other:
                held[key], other, mine = mine, mine, other
            doc_, at = mine
            if repeats and repeats[-1][0] == doc_ and repeats[-1][2] == at - 1:
                repeats[-1] = (doc_, repeats[-1][1], at)
            else:
                repeats.append((doc_, at, at))
    return held


_RUN = "part long, doc_id long, data binary, start long"


def _run_rows(part: list, doc: list, blob: list, start: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(doc, pa.int64()), pa.array(blob, pa.binary()), pa.array(start, pa.int64())], ["part", "doc_id", "data", "start"])


def _runs(parts: int, segment: int):
    """Runs (part, data), windows of frequent grams (doc_id, data: the digest, start), and repeats already seen (doc_id, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        held: dict[tuple[bytes, int], tuple[int, int, int, int]] = {}
        repeats: list[tuple[int, int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            hot = []
            for (context, left), (doc, first, windows, g) in held.items():
                if g is None:
                    hot.append((context, doc, first, windows))
                else:
                    by.setdefault(g % parts, []).append((context[left:], context[:left], doc, first, windows))
            for k in range(0, len(hot), HOT_CONTEXTS):
                seen = distinct_windows(hot[k : k + HOT_CONTEXTS], repeats)
                yield _run_rows([None] * len(seen), [d for d, _ in seen.values()], list(seen), [a for _, a in seen.values()])
            covered = joined_intervals(repeats)
            part = [*by, *[None] * len(covered)]
            blob = [*(write_run(sorted(x)) for x in by.values()), *covered.values()]
            yield _run_rows(part, [*[None] * len(by), *covered], blob, [None] * len(part))
            held.clear()
            repeats.clear()

        for b in slices(batches):
            for doc, text, shared, hot in zip(column(b, "doc_id"), column(b, "t"), column(b, "gs"), column(b, "hs"), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                g, place, first, last = anchors(np.frombuffer(raw, np.uint8), grams, segment)
                pick = np.isin(g, np.array(shared, np.int64).view(np.uint64))
                frequent = {x % (1 << 64) for x in hot}
                for h, p, a, z in zip(*(x[pick].tolist() for x in (g, place, first, last)), strict=True):
                    key, mine = (raw[a : z + LENGTH], p - a), (doc, a, z - a + 1, None if h in frequent else h)
                    other = held.get(key)
                    if other is None:
                        held[key] = mine
                        continue
                    if mine[:2] < other[:2]:
                        held[key], mine = mine, other
                    repeats.append((mine[0], mine[1], mine[1] + mine[2] - 1))
            if len(held) + len(repeats) >= RUN_CONTEXTS:
                yield from flush()
        if held or repeats:
            yield from flush()

    return run


def _merge(pairwise: int):
    def run(table: pa.Table) -> pa.Table:
        windows: list[tuple[int, int, int]] = []
        group: list = []
        for shared, suffix, more in merge_runs([read_run(x) for x in table.column("data").to_pylist()]):
            if shared < GRAM:
                if len(group) > 1:
                    windows += repeated_windows(group, pairwise)
                group = []
            group.append((suffix, more))
        if len(group) > 1:
            windows += repeated_windows(group, pairwise)
        out = joined_intervals(windows)
        return pa.table([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["doc_id", "data"])

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out = joined_intervals([(doc, a, a) for doc, starts in zip(column(b, "doc_id"), column(b, "starts"), strict=True) for a in starts])
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["doc_id", "data"])


def later_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, data) intervals of the windows (data: the digest, doc_id, start) that also start earlier. A digest has one first row, so no group is held."""
    at = F.struct("doc_id", "start")
    first = windows.groupBy("data").agg(F.min(at).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, "data").filter(at > F.col("head"))
    return later.groupBy("doc_id").agg(F.collect_list("start").alias("starts")).mapInArrow(_spans, "doc_id long, data binary")


def repeated_intervals(docs: DataFrame, segment: int = SEGMENT, pairwise: int = PAIRWISE) -> DataFrame:
    """(doc_id, spans): for documents (doc_id unique, t) the intervals of bytes in windows that also start earlier, in pieces that may overlap."""
    spark = docs.sparkSession
    rows = stash(docs.mapInArrow(_gram_rows(segment), "g long, doc_id long, c long"), "grams")
    shared = stash(rows.groupBy("g").agg(F.sum("c").alias("c")).filter("c > 1").select("g", (F.col("c") > HOT_GRAM).alias("hot")), "shared")
    lists = stash(rows.select("g", "doc_id").join(shared, "g"), "places")
    n = lists.count()
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // PART_CONTEXTS)
    by_doc = lists.groupBy("doc_id").agg(F.collect_list("g").alias("gs"), F.collect_list(F.when(F.col("hot"), F.col("g"))).alias("hs"))
    runs = stash(docs.join(by_doc, "doc_id").mapInArrow(_runs(parts, segment), _RUN), "runs")
    merged = runs.filter("part is not null").select("part", "data").groupBy("part").applyInArrow(_merge(pairwise), "doc_id long, data binary")
    found = runs.filter("part is null and start is null").select("doc_id", "data").unionByName(merged)
    if not shared.filter("hot").isEmpty():
        found = found.unionByName(later_windows(runs.filter("start is not null").select("data", "doc_id", "start")))
    return stash(found, "intervals")


def removal(raw: bytes, spans: list[bytes] | None) -> tuple[bytes, int, list[tuple[int, int]]]:
    """What is left of a text, the bytes removed and the maximal removed runs."""
    runs: list[list[int]] = []
    pairs = np.frombuffer(b"".join(spans or []), "<i8").reshape(-1, 2)
    for a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), sum(b - a for a, b in runs), [(a, b) for a, b in runs]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        made = []
        for doc, text, whole, spans in zip(column(b, "doc_id"), column(b, "t"), column(b, "whole"), column(b, "spans"), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            kept, gone, runs = (b"", len(raw), [(0, len(raw))]) if whole and len(raw) >= LENGTH else removal(raw, spans)
            flat = [{"from": x, "to": y} for x, y in runs]
            made.append((doc, len(raw), gone, flat, hashlib.sha256(kept).hexdigest(), kept))
        if made:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, pairwise: int = PAIRWISE) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (maximal removed runs, from and to), kept_sha256 and kept (the bytes left).

    A byte goes if a LENGTH-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Null and empty texts are no bytes. Whole copies are settled by their digest: all but the smallest doc_id
    go, if as long as a repeat. Rows with a null id take no part. Of rows with one id and different texts, that of the
    smallest digest takes part and the others stay as they are; equal rows are cut alike. No result depends on ``segment`` and ``pairwise``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    digests = rows.filter("doc_id is not null and t is not null").select("doc_id", F.sha2("t", 256).alias("digest"))
    own = digests.groupBy("doc_id").agg(F.min("digest").alias("digest"))
    first = stash(own.groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")
    known = stash(own.join(first, "digest").select("doc_id", "digest", (F.col("first") < F.col("doc_id")).alias("whole")), "known")
    mark = F.sha2("t", 256)
    copies = known.filter("whole").select(F.col("doc_id").alias("k"))
    if rows.filter("doc_id is not null and t is not null").count() == known.count():
        # ids are unique: all but the copies, whose ids are few enough to send, so the texts stay where they are
        few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        heads = rows.filter("doc_id is not null and t is not null").join(F.broadcast(copies) if few else copies, F.col("doc_id") == F.col("k"), "left_anti")
    else:
        firsts = known.filter("not whole").select(F.col("doc_id").alias("k"), F.col("digest").alias("kd"))
        heads = rows.join(firsts, (F.col("doc_id") == F.col("k")) & (F.sha2("t", 256) == F.col("kd")), "left_semi").dropDuplicates(["doc_id"])
    found = repeated_intervals(heads, segment, pairwise).groupBy("doc_id").agg(F.collect_list("data").alias("spans"))
    found = stash(known.join(found, "doc_id", "left").filter("whole or spans is not null").select(F.col("doc_id").alias("k"), F.col("digest").alias("kd"), "whole", "spans"), "cuts")
    # always by a shuffle, whatever the size of ``found``: it grows with the input
    marked = rows.join(found.hint("merge"), (F.col("doc_id") == F.col("k")) & (mark == F.col("kd")), "left")
    return marked.select("doc_id", "t", F.coalesce("whole", F.lit(False)).alias("whole"), "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept_sha256 string, kept binary")
