"""Phrase collocations from counts of all 2- to 4-word phrases, taken by HAT-tries that spill sorted runs.

Words are counted first. Of the words that a phrase may hold (LEAST occurrences in their language) the most frequent get ids, and
the most frequent of these, fewer than ``hot_share``, are called hot. Each task then counts windows of up to four ids in a trie:
the first word's id leads to a subtree, the rest of the window is hashed in the subtree's containers. A container that is
full bursts into two, for lower and higher ids of the next words. When the trie is full, its largest subtrees are spilled
whole as sorted runs, cut by prefix partition. A partition's runs are merged in order, so that its task holds only what
overlaps, and a window counts for each of its prefixes of two words or more.

The prefix that names a partition ends at its first word that is not hot. So no partition holds much more than one word in
``hot_share`` brings, and all prefixes with such a word are complete in their partition; those of hot words alone are summed
over partitions afterwards. Words beyond the ids (too many, or too long) lose nothing: phrases with them travel as text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, slices, small_batches, stash

MOST_WORDS, LEAST, TOP = 4, 30, 2000
#: A candidate goes if a longer one that holds it has this share of its occurrences, in hundredths.
COVERED_PERCENT = 80
SCALE = 2_000_000
#: Bits of one id in a key, and cells that tell whether a word without id may be frequent.
ID_BITS, LATE_CELLS = 20, 1 << 20
#: Candidates ranked together before the ranks of a language.
RANKED = 100_000

SEPARATORS = ".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CUT = bytes(ord(".") if chr(c) in SEPARATORS else c for c in range(256))
_ID = (1 << ID_BITS) - 1
RUNS = "lang string, part long, low long, lowest long, run binary, phrase string, f long"


class Limits(NamedTuple):
    """Bounds of what is held at once; no result depends on them."""

    #: Words with ids, and their longest in bytes.
    word_ids: int = 1 << 19
    id_bytes: int = 64
    #: A word is hot that is more than one in so many.
    hot_share: int = 256
    #: Tokens fed at once, entries of a container, of a trie, and of a block of a run.
    feed: int = 1 << 18
    burst: int = 1 << 14
    entries: int = 1_000_000
    run: int = 1 << 15
    #: Words of a partition on average, and entries merged at once in it.
    part_words: int = 2_000_000
    merge: int = 1_000_000


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with b"." where a piece ends."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_CUT).replace(b".", b" . ").split() if text else []


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of rows (lang, t). Words are lower-cased once they are few."""
    raw = rows.select("lang", F.explode(F.split("t", r"[.,;:!?\n-\r\t ]+")).alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f"))
    return raw.groupBy("lang", F.translate("word", UPPER, LOWER).alias("word")).agg(F.sum("f").alias("f"))


class Words:
    """Ids of frequent words from 1 on, hot words first; -1 for a word that may be frequent but has none, 0 for others."""

    def __init__(self, frequent: DataFrame, total: int, limits: Limits) -> None:
        limit, longest = limits.word_ids, limits.id_bytes
        both = frequent.groupBy("word").agg(F.sum("f").alias("f"))
        with_id = both.filter(F.octet_length("word") <= longest).orderBy(F.desc("f"), "word").limit(limit)
        top = with_id.toArrow()
        counts = top.column("f").to_numpy()
        self.words = [b".", *(w.encode() for w in top.column("word").to_pylist())]
        self.hot = int((counts * limits.hot_share > total).sum())
        late = F.octet_length("word") > longest
        if len(counts) == limit:
            least, last = int(counts[-1]), top.column("word")[-1].as_py()
            late = late | (F.col("f") < least) | ((F.col("f") == least) & (F.col("word") > last))
        cells = both.filter(late).select(F.pmod(F.xxhash64("word"), F.lit(LATE_CELLS)).alias("c")).distinct().toArrow().column("c").to_numpy()
        self.late = np.packbits(np.isin(np.arange(LATE_CELLS), cells)) if len(cells) else None

    def ids(self) -> dict[bytes, int]:
        late = None if self.late is None else np.unpackbits(self.late).tobytes()

        class Ids(dict):
            def __missing__(self, word: bytes) -> int:
                return -late[xxhash.xxh64_intdigest(word, 42) % LATE_CELLS] if late else 0

        out = Ids({w: k for k, w in enumerate(self.words)})
        out[b"."] = 0
        return out


class Subtree:
    """Windows that start with one word: containers hold the counts of what follows, each for a range of it."""

    __slots__ = ("limit", "lows", "held")

    def __init__(self, limit: int) -> None:
        self.limit, self.lows, self.held = limit, [0], [Counter()]

    def add(self, rest: np.ndarray) -> int:
        """Count each of ``rest``; how many new entries that makes."""
        if len(self.held) == 1:
            parts = [(0, rest)]
        else:
            rest = np.sort(rest)
            at = np.searchsorted(rest, self.lows[1:]).tolist()
            parts = [(k, rest[s:e]) for k, (s, e) in enumerate(zip([0, *at], [*at, len(rest)], strict=True)) if e > s]
        new = 0
        for k, own in reversed(parts):  # a burst moves only the places behind it
            c = self.held[k]
            before = len(c)
            c.update(own.tolist())
            new += len(c) - before
            if len(c) > self.limit:
                self.burst(k)
        return new

    def burst(self, k: int) -> None:
        keys = sorted(self.held[k])
        middle = keys[len(keys) // 2]
        if (word := middle >> 2 * ID_BITS << 2 * ID_BITS) > keys[0]:
            middle = word  # between two words, where there is such a place
        low, high = Counter(), Counter()
        for x, c in self.held[k].items():
            (high if x >= middle else low)[x] = c
        self.held[k : k + 1] = [low, high]
        self.lows.insert(k + 1, middle)

    def __len__(self) -> int:
        return sum(map(len, self.held))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(rest, count) in order."""
        keys = np.concatenate([np.fromiter(c.keys(), np.int64, len(c)) for c in self.held])
        counts = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in self.held])
        order = np.argsort(keys, kind="stable")
        return keys[order], counts[order]


class HatTrie:
    """Counts of windows by language, in at most ``limits.entries`` entries; what is beyond is spilled as rows of RUNS."""

    def __init__(self, hot: int, parts: int, limits: Limits) -> None:
        self.hot, self.parts, self.limits, self.size = hot, parts, limits, 0
        self.roots: dict[str, dict[int, Subtree]] = {}

    def feed(self, lang: str, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the windows of ``ids``, in which 0 and -1 stand between pieces."""
        a = np.concatenate([ids, np.zeros(MOST_WORDS - 1, np.int64)]).clip(0)
        n = len(ids)
        first, second, third, fourth = (a[k : k + n] for k in range(MOST_WORDS))
        third = np.where(second > 0, third, 0)
        fourth = np.where(third > 0, fourth, 0)
        some = np.flatnonzero((first > 0) & (second > 0))
        if not len(some):
            return
        some = some[np.argsort(first[some], kind="stable")]
        first, rest = first[some], (second << 2 * ID_BITS | third << ID_BITS | fourth)[some]
        edge = np.flatnonzero(np.diff(first, prepend=-1))
        root = self.roots.setdefault(lang, {})
        for w, s, e in zip(first[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(first)], strict=True):
            tree = root.get(w)
            if tree is None:
                tree = root[w] = Subtree(self.limits.burst)
            self.size += tree.add(rest[s:e])
        if self.size > self.limits.entries:
            yield from self.spill(self.size - self.limits.entries // 2)

    def spill(self, least: int) -> Iterator[pa.RecordBatch]:
        """Spill whole subtrees, the largest first, until ``least`` entries are gone."""
        sizes = sorted(((len(t), lang, w) for lang, root in self.roots.items() for w, t in root.items()), reverse=True)
        taken: dict[str, list[int]] = {}
        for n, lang, w in sizes:
            if least <= 0:
                break
            taken.setdefault(lang, []).append(w)
            least -= n
            self.size -= n
        for lang, ws in taken.items():
            ws.sort()
            runs = [self.roots[lang].pop(w).run() for w in ws]
            first = np.repeat(np.array(ws, np.int64), [len(r) for r, _ in runs])
            yield from self.blocks(lang, first, *(np.concatenate(x) for x in zip(*runs, strict=True)))

    def blocks(self, lang: str, first: np.ndarray, rest: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = parts_of(lang, first, rest, self.hot, self.parts)
        order = np.argsort(part, kind="stable")
        part, first, rest, count = part[order], first[order], rest[order], count[order]
        edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            for k in range(s, e, self.limits.run):
                own = slice(k, min(k + self.limits.run, e))
                yield _rows(lang, int(part[s]), int(first[k]), int(rest[k]), packed(first[own], rest[own], count[own]))


def _rows(lang: str, part: int, low: int, lowest: int, run: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int64()), pa.array([low], pa.int64()), pa.array([lowest], pa.int64()), pa.array([run], pa.binary()), pa.array([None], pa.string()), pa.array([None], pa.int64())], ["lang", "part", "low", "lowest", "run", "phrase", "f"])


def parts_of(lang: str, first: np.ndarray, rest: np.ndarray, hot: int, parts: int) -> np.ndarray:
    """The partition of each window, by its words up to the first that is not hot."""
    step = np.uint64(0x9E3779B97F4A7C15)
    h = first.astype(np.uint64) + np.uint64(xxhash.xxh64_intdigest(lang.encode(), 7))
    on = first <= hot
    for k in (2, 1, 0):
        word = rest >> k * ID_BITS & _ID
        h = np.where(on, (h ^ h >> np.uint64(31)) * step + word.astype(np.uint64), h)
        on = on & (word <= hot)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ h >> np.uint64(31)) % np.uint64(parts)).astype(np.int64)


def packed(first: np.ndarray, rest: np.ndarray, count: np.ndarray) -> bytes:
    """A sorted run by columns; equal prefixes shrink to almost nothing."""
    words = [np.diff(first, prepend=0), *(rest >> k * ID_BITS & _ID for k in (2, 1, 0))]
    small = np.concatenate(words).astype(np.int32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(first).to_bytes(8, "little") + small + count.astype(np.int64).tobytes())


def unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(run)
    n = int.from_bytes(raw[:8], "little")
    words = np.frombuffer(raw, np.int32, 4 * n, 8).reshape(4, n).astype(np.int64)
    return np.cumsum(words[0]), words[1] << 2 * ID_BITS | words[2] << ID_BITS | words[3], np.frombuffer(raw, np.int64, n, 8 + 16 * n)


def spilled(rows: DataFrame, words, parts: int, limits: Limits) -> DataFrame:
    """RUNS of all windows of rows (lang, t); phrases with a word that has no id come as text with their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = words.value.ids()
        trie = HatTrie(words.value.hot, parts, limits)
        waiting: dict[str, list[np.ndarray]] = {}
        size: Counter = Counter()
        texts: Counter = Counter()

        def as_text() -> Iterator[pa.RecordBatch]:
            if texts:
                keys = [p.decode("utf-8", "surrogatepass") for _, p in texts]
                part = [xxhash.xxh64_intdigest(p) % parts for _, p in texts]
                none = pa.nulls(len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array(part, pa.int64()), none, none, pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(list(texts.values()), pa.int64())], ["lang", "part", "low", "lowest", "run", "phrase", "f"])
                texts.clear()

        gap = np.zeros(1, np.int64)
        for b in slices(batches):
            for lang, text in zip(column(b, "lang"), column(b, "t"), strict=True):
                tokens = tokens_of(text)
                own = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
                if words.value.late is not None:
                    for p in np.flatnonzero(own == -1).tolist():
                        for s in range(max(0, p - MOST_WORDS + 1), p + 1):
                            if (own[s:p] <= 0).any():
                                continue  # another such word or a gap stands before it
                            for e in range(max(p + 1, s + 2), min(len(own), s + MOST_WORDS) + 1):
                                if own[e - 1] == 0:
                                    break
                                texts[lang, b" ".join(tokens[s:e])] += 1
                    if len(texts) > limits.run:
                        yield from as_text()
                waiting.setdefault(lang, []).extend((own, gap))
                size[lang] += len(own) + 1
                if size[lang] >= limits.feed:
                    yield from trie.feed(lang, np.concatenate(waiting.pop(lang)))
                    size[lang] = 0
        for lang, held in waiting.items():
            yield from trie.feed(lang, np.concatenate(held))
        yield from trie.spill(trie.size)
        yield from as_text()

    return rows.mapInArrow(run, RUNS)


def merged(runs: DataFrame, words, least: int, merge: int) -> DataFrame:
    """(lang, phrase, f): sums of every phrase of ``least`` or more; where a sum may go on elsewhere, it comes in several rows."""

    def found(lang: str, first: np.ndarray, rest: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        w = words.value
        for order in range(2, MOST_WORDS + 1):
            key = rest >> (MOST_WORDS - order) * ID_BITS
            new = np.flatnonzero((np.diff(first, prepend=-1) != 0) | (np.diff(key, prepend=-1) != 0))
            sums = np.add.reduceat(count, new)
            a, k = first[new], key[new]
            ids = [a, *(k >> j * ID_BITS & _ID for j in reversed(range(order - 1)))]
            keep = (sums >= least) | np.logical_and.reduce([x <= w.hot for x in ids])
            keep[[0, -1]] = True  # these may go on before or behind what is at hand
            keep &= ids[-1] > 0
            if keep.any():
                texts = [b" ".join(map(w.words.__getitem__, row)).decode() for row in zip(*(x[keep].tolist() for x in ids), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts)), pa.array(texts), pa.array(sums[keep])], ["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, size, limit = None, 0, merge

        def taken(low: int | None = None, lowest: int = 0) -> tuple[list, tuple | None]:
            """What is held in order, sums of equal windows: (entries that stay, entries before (low, lowest))."""
            first, rest, count = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((rest, first))
            first, rest, count = first[order], rest[order], count[order]
            new = np.flatnonzero((np.diff(first, prepend=-1) != 0) | (np.diff(rest, prepend=-1) != 0))
            first, rest, count = first[new], rest[new], np.add.reduceat(count, new)
            if low is None:
                return [], (first, rest, count)
            end = int(np.searchsorted(first, low))
            end += int(np.searchsorted(rest[end : np.searchsorted(first, low, "right")], lowest))
            return [(first[end:], rest[end:], count[end:])] if end < len(first) else [], (first[:end], rest[:end], count[:end]) if end else None

        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                if row["phrase"] is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([row[x]]) for x in ("lang", "phrase", "f")], ["lang", "phrase", "f"])
                    continue
                if held and (row["part"], row["lang"]) != at:
                    yield from found(at[1], *taken()[1])
                    held, size, limit = [], 0, merge
                elif size > limit:
                    held, done = taken(row["low"], row["lowest"])
                    if done:
                        yield from found(at[1], *done)
                    size = sum(len(x[0]) for x in held)
                    limit = max(merge, 2 * size)
                at = row["part"], row["lang"]
                held.append(unpacked(row["run"]))
                size += len(held[-1][0])
        if held:
            yield from found(at[1], *taken()[1])

    return runs.repartition("part").sortWithinPartitions("part", "lang", "low", "lowest").mapInArrow(run, "lang string, phrase string, f long")


def phrase_counts(rows: DataFrame, frequent: DataFrame, total: int, least: int, limits: Limits) -> DataFrame:
    """(lang, phrase, f) of all phrases of 2 to MOST_WORDS words with ``least`` occurrences or more."""
    words = rows.sparkSession.sparkContext.broadcast(Words(frequent, total, limits))
    parts = max(1, -(-total // limits.part_words))
    sums = merged(spilled(rows, words, parts, limits), words, least, limits.merge).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return sums.filter(F.col("f") >= least)


def _joined(cuts: DataFrame, counts: DataFrame, hot: DataFrame, side: str) -> DataFrame:
    """``cuts`` with the count of their part ``side``: few parts stand in very many cuts, and get theirs by a broadcast."""
    named = lambda x: x.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0]))
    many = F.broadcast(named(hot))
    return cuts.join(many, ["lang", side]).unionByName(cuts.join(many, ["lang", side], "left_anti").join(named(counts), ["lang", side]))


def scored(phrases: DataFrame, singles: DataFrame, least_hot: int) -> DataFrame:
    """``phrases`` (lang, phrase, f) with a, l, r, score of their lowest-scoring cut, the first one of equal scores.

    Counts of words above ``least_hot`` are broadcast.
    """
    words, wide = F.split("phrase", " "), lambda x: F.col(x).cast("decimal(19,0)")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"), words.alias("w"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("left"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("right"))
    counts, hot = singles.unionByName(phrases), singles.filter(F.col("f") > least_hot)
    cuts = _joined(_joined(cuts, counts, hot, "left"), counts, hot, "right")
    cuts = cuts.withColumns({"sum": wide("l") + wide("r"), "product": wide("a") * F.lit(SCALE).cast("decimal(7,0)")})
    cuts = cuts.withColumn("score", F.expr("product div sum"))
    return cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"), F.first("a").alias("a")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def not_covered(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """``found`` without phrases that stand mostly in longer ones of ``phrases``."""
    w = F.split("phrase", " ")
    inner = phrases.select("lang", F.col("f"), w.alias("w")).filter(F.size("w") > 2)
    inner = inner.withColumn("n", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("s", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    inner = inner.groupBy("lang", F.concat_ws(" ", F.slice("w", F.col("s"), F.col("n"))).alias("phrase")).agg(F.max("f").alias("longer"))
    share = F.col("longer").cast("decimal(21,0)") * 100 >= F.col("a").cast("decimal(21,0)") * COVERED_PERCENT
    return found.join(inner, ["lang", "phrase"], "left").filter(~F.coalesce(share, F.lit(False))).drop("longer")


def top_ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank: first within parts of RANKED rows, then among what these leave."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = F.lit(found.count() // RANKED + 1)
    dealt = found.withColumn("part", F.pmod(F.xxhash64("phrase"), parts))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return first.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` collocations of each language.

    A null language is ``und``, as is a language of that name; null and empty texts, and those of marks only, have no words.
    Rows that repeat count each time. Ties go by score, count, then phrase in byte order. A language without candidates, or
    an empty table, gives no rows. Other columns take no part.
    """
    rows = small_batches(docs).select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    vocabulary = stash(word_counts(rows), "words")
    sizes = stash(vocabulary.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    frequent = vocabulary.filter(F.col("f") >= least)
    phrases = stash(phrase_counts(rows, frequent, total, least, limits), "phrases")
    found = scored(phrases, frequent.select("lang", F.col("word").alias("phrase"), "f"), total // limits.hot_share)
    first = top_ranked(stash(not_covered(found, phrases), "scored"), top)
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
