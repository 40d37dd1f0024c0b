"""Helpers shared by the corpus operators: written intermediate tables, words, shingles, token ids."""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import discard, shared_folder  # noqa: F401
from ..sources.shared import written as stash  # noqa: F401

#: Words of one shingle, and the Jaccard similarity (in hundredths) from which sets count as near copies.
SHINGLE_WORDS = 5
NEAR_PERCENT = 80
#: Words whose ids a worker keeps for good, and as many that it keeps for a while. Several workers share an executor.
CACHE_ENTRIES = 75_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch of texts: a worker holds it several times over, as Arrow, as str and as arrays.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after its session's limits of Arrow batches are lowered to BATCH_ROWS and BATCH_BYTES; lower ones stay. No row is left out.

    Spark takes these limits from the session when a plan runs, so they hold for the session from then on.
    """
    conf = docs.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{key}", None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            conf.set(f"spark.sql.execution.arrow.{key}", most)
    return docs


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at space and the bytes 9 to 13. bytes.lower() and bytes.split() do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
#: Bytes hashed at once, and bytes from which a word is hashed by itself.
WINDOW_BYTES = 1 << 18
LONG_WORD = 512
_SPACES = re.compile(rb"[ \t-\r]")


class WordHashes:
    """64-bit hashes of the words of texts, by running sums over many texts at once.

    A word's hash is a polynomial modulo 2**64 over random byte values; the same for upper and lower case A-Z.
    """

    def __init__(self) -> None:
        token_ids.cache_clear()  # what this worker kept from tasks on tokens would stand beside the hashes
        values = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        values[65:91] = values[97:123]
        self.values, self.space = values, np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.up, self.down = (np.full(2 * WINDOW_BYTES, base, np.uint64) for base in (int(_STEP), pow(int(_STEP), -1, 1 << 64)))
        for steps in (self.up, self.down):
            steps[0] = 1
            np.multiply.accumulate(steps, out=steps)

    def window(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place of the end) of each word of at most 2 * WINDOW_BYTES bytes."""
        data = np.frombuffer(raw, np.uint8)
        gap = self.space[data]
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        start, end = edge[0::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.down[: len(data)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.up[start]
        h ^= h >> np.uint64(29)
        h *= _MIX_A
        h ^= h >> np.uint64(32)
        for k in np.flatnonzero(end - start >= LONG_WORD).tolist():
            h[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]].lower())
        return h, end

    def long_text(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of one text, window by window; a word longer than a window is hashed by itself."""
        out, at = [], 0
        while at < len(raw):
            end = at + WINDOW_BYTES
            if end < len(raw):
                m = _SPACES.search(raw, end, at + 2 * WINDOW_BYTES)
                if m is None:
                    m = _SPACES.search(raw, end)
                    end = m.start() if m else len(raw)
                    words = raw[at:end].rsplit(None, 1)
                    last = xxhash.xxh3_64_intdigest(words.pop().lower())
                    out += [self.window(w)[0] for w in words]
                    out.append(np.array([last], np.uint64))
                    at = end
                    continue
                end = m.end()
            out.append(self.window(raw[at:end])[0])
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def each(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The hashes of each text's words in turn; null and empty texts have none."""
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            h, end = self.window(b"\n".join(held))
            yield from np.split(h, np.searchsorted(end, np.cumsum([len(x) + 1 for x in held[:-1]], dtype=np.int64)))

        for text in texts:
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            if held and size + len(raw) >= WINDOW_BYTES:
                yield from flush()
                held, size = [], 0
            if len(raw) >= WINDOW_BYTES:
                yield self.long_text(raw)
                continue
            held.append(raw)
            size += len(raw) + 1
        if held:
            yield from flush()


def shingle_hashes(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the n-word shingles in text order from the hashes of words; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(n, len(words))
    m = len(words) - width + 1
    out = words[:m].copy()
    for k in range(1, width):
        out *= _STEP
        out += words[k : k + m]
    if width < n:
        out += np.uint64(width)
    out ^= out >> np.uint64(30)
    out *= _MIX_A
    out ^= out >> np.uint64(27)
    out *= _MIX_B
    out ^= out >> np.uint64(31)
    return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(x) if x in prints else chr(next(rest)) for x in range(256)]


_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
#: Texts that the tokenizer's normalizer only lower-cases, letter by letter, and what it then encodes apart.
_PLAIN = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PIECES = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9{_LETTERS}]+")


class TokenIds(dict):
    """Token ids (little-endian unsigned 32 bits) of texts, with each word or run of marks encoded once.

    The first CACHE_ENTRIES words stay, frequent ones are among them; as many later ones are kept till these are full.
    """

    def __init__(self, tokenizer_path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model, self.letters, self.late = self.tokenizer.model, byte_letters(), {}

    def __missing__(self, word: str) -> bytes:
        ids = self.late.get(word)
        if ids is None:
            inner = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            got = self.model.tokenize(inner)
            ids = struct.pack(f"<{len(got)}I", *[t.id for t in got])
            if len(self) < CACHE_ENTRIES:
                self[word] = ids
            else:
                if len(self.late) >= CACHE_ENTRIES:
                    self.late.clear()
                self.late[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _PLAIN.fullmatch(text) and "<|" not in text:  # "<|" may begin a special token
            return b"".join(map(self.__getitem__, _PIECES.findall(text.lower())))
        # the tokenizer drops white space and never merges across it; str.split() also cuts at these four, which it keeps
        if len(chunks := text.split()) > 1 and not any(x in text for x in "\x1c\x1d\x1e\x1f"):
            return b"".join(map(self.of, chunks))
        ids = self.late.get(text)
        if ids is None:
            ids = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            if len(text) <= LONG_WORD:
                self.late[text] = ids
        return ids


@functools.cache
def token_ids(tokenizer_path: str | None) -> TokenIds:
    """The ids known to this Python worker: later tasks go on with them."""
    return TokenIds(tokenizer_path or default_tokenizer())


def default_tokenizer() -> str:
    """Path of the public word-level BPE vocabulary, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches cut to few rows, so that what is made from them stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
