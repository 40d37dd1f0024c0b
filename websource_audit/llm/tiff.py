"""TIFF media columns: write 8-bit grey images, walk image directories and emit one row per page."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices, small_batches

# Fixed values of the TIFF 6.0 format: tags, field sizes by type, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END = 256, 257

PAGE_SCHEMA = "page int, width int, height int, samples_per_pixel int, compression int, predictor int, samples binary, error string"


#: Most samples that one byte of a strip can give: a header may claim any size, but memory is taken only for what the strips at hand can hold.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 2731, DEFLATE: 1032, OLD_DEFLATE: 1032}


class TiffError(ValueError):
    """A file that is not readable as TIFF."""


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a signed count, then that many literal bytes plus one, or one byte to repeat."""
    out, k = bytearray(), 0
    while k < len(data) and len(out) < size:
        n = data[k]
        k += 1
        if n < 128:
            out += data[k : k + n + 1]
            k += n + 1
        elif n > 128:
            out += data[k : k + 1] * (257 - n)
            k += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Literal runs of up to 128 bytes, and repeats of three bytes or more."""
    out, k, lit = bytearray(), 0, 0
    while k < len(data):
        n = 1
        while n < 128 and k + n < len(data) and data[k + n] == data[k]:
            n += 1
        if n >= 3 or k - lit == 128:
            if k > lit:
                out.append(k - lit - 1)
                out += data[lit:k]
                lit = k
            if n >= 3:
                out += bytes((257 - n, data[k]))
                k += n
                lit = k
            continue
        k += 1
    if k > lit:
        out.append(k - lit - 1)
        out += data[lit:k]
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first; the width grows one code early."""
    out, bits, held, k, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    last = b""
    while len(out) < size:
        while held < width:
            if k == len(data):
                return bytes(out)
            bits, held, k = (bits << 8 | data[k]) & 0xFFFFFF, held + 8, k + 1
        held -= width
        code = bits >> held & ((1 << width) - 1)
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, width, last = [bytes((x,)) for x in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise TiffError("LZW data before a clear code")
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """The inverse of lzw_decode."""
    out, bits, held = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, fresh = 9, 258

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(LZW_CLEAR)
    table, now = {bytes((x,)): x for x in range(256)}, b""
    for x in data:
        more = now + bytes((x,))
        if more in table:
            now = more
            continue
        put(table[now])
        table[more] = fresh
        fresh += 1
        width = 12 if fresh >= 2048 else 11 if fresh >= 1024 else 10 if fresh >= 512 else 9
        if fresh == 4094:
            put(LZW_CLEAR)
            table, width, fresh = {bytes((y,)): y for y in range(256)}, 9, 258
        now = bytes((x,))
    if now:
        put(table[now])
        fresh += 1
        width = 12 if fresh >= 2048 else 11 if fresh >= 1024 else 10 if fresh >= 512 else 9
    put(LZW_END)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def squeeze(block: np.ndarray, compression: int, predictor: int) -> bytes:
    """One strip or tile (rows, columns, samples) as stored."""
    if predictor == 2:
        block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
    raw = block.tobytes()
    if compression == DEFLATE:
        return zlib.compress(raw, 1)
    if compression == LZW:
        return lzw_encode(raw)
    return pack_bits(raw) if compression == PACKBITS else raw


def encode_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 512, tile: int | None = None) -> bytes:
    """A little-endian TIFF of 8-bit pages (rows, columns): in strips, or in square tiles of ``tile`` samples."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        high, wide = page.shape
        if tile:
            full = np.zeros((-(-high // tile) * tile, -(-wide // tile) * tile), np.uint8)
            full[:high, :wide] = page
            blocks = [full[y : y + tile, x : x + tile] for y in range(0, full.shape[0], tile) for x in range(0, full.shape[1], tile)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, high, rows_per_strip)]
        at, sizes = [], []
        for block in blocks:
            data = squeeze(block[:, :, None], compression, predictor)
            at.append(len(out))
            sizes.append(len(data))
            out += data
        fields = [(WIDTH, [wide]), (HEIGHT, [high]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
        fields += [(TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (TILE_OFFSETS, at), (TILE_BYTES, sizes)] if tile else [(STRIP_OFFSETS, at), (ROWS_PER_STRIP, [rows_per_strip]), (STRIP_BYTES, sizes)]
        entries = []
        for tag, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                packed, where = struct.pack("<I", len(out)), packed
                out += where
            entries.append(struct.pack("<HHI", tag, 4, len(values)) + packed)
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The fields of each image directory, in file order; a loop of directories is an error."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    e = "<" if data[:2] == b"II" else ">"
    seen, (at,) = set(), struct.unpack_from(e + "I", data, 4)
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("broken chain of directories")
        seen.add(at)
        (n,) = struct.unpack_from(e + "H", data, at)
        if at + 6 + 12 * n > len(data):
            raise TiffError("directory past the end")
        fields = {}
        for k in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack_from(e + "HHI", data, k)
            code = {1: "B", 3: "H", 4: "I"}.get(kind)
            if code is None:
                continue
            size = TYPE_SIZE[kind] * count
            where = k + 8 if size <= 4 else struct.unpack_from(e + "I", data, k + 8)[0]
            if where + size > len(data):
                raise TiffError("field past the end")
            if not count:
                continue
            fields[tag] = struct.unpack_from(f"{e}{count}{code}", data, where)
        yield fields
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def page_samples(data: bytes, ifd: dict[int, tuple[int, ...]]) -> np.ndarray:
    """The 8-bit samples of one page: (rows, columns, samples per pixel)."""
    one = lambda tag, default=None: ifd.get(tag, (default,))[0]
    wide, high, spp, comp, pred = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if not (wide and high and spp):
        raise TiffError("page without a size")
    if set(ifd.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1 or pred not in (1, 2):
        raise TiffError("only 8-bit interleaved samples are read")
    tiled = TILE_OFFSETS in ifd
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (wide, min(one(ROWS_PER_STRIP, high), high))
    at, sizes = (ifd.get(TILE_OFFSETS), ifd.get(TILE_BYTES)) if tiled else (ifd.get(STRIP_OFFSETS), ifd.get(STRIP_BYTES))
    across, down = -(-wide // bw) if bw else 0, -(-high // bh) if bh else 0
    if at is None or sizes is None or len(at) != len(sizes) or len(at) != across * down:
        raise TiffError("wrong number of strips or tiles")
    if comp not in EXPANSION:
        raise TiffError(f"compression {comp} is not read")
    there = sum(max(0, min(n, len(data) - start)) for start, n in zip(at, sizes, strict=True))
    if (down * bh if tiled else high) * across * bw * spp > EXPANSION[comp] * there:
        raise TiffError("more samples than the strips or tiles can hold")
    out = np.zeros((down * bh, across * bw, spp), np.uint8)
    for k, (start, n) in enumerate(zip(at, sizes, strict=True)):
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, high - y)
        size = rows * bw * spp
        raw = data[start : start + n]
        if comp in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompressobj().decompress(raw, size)
        elif comp == LZW:
            raw = lzw_decode(raw, size)
        elif comp == PACKBITS:
            raw = unpack_bits(raw, size)
        if len(raw) < size:
            raise TiffError("strip or tile too short")
        block = np.frombuffer(raw, np.uint8, size).reshape(rows, bw, spp)
        out[y : y + rows, x : x + bw] = np.add.accumulate(block, axis=1, dtype=np.uint8) if pred == 2 else block
    return out[:high, :wide]


def tiff_pages(files: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of each TIFF in ``media_col``: id, media_bytes, media_sha256, then PAGE_SCHEMA.

    A page that can't be decoded gives a row with its number and the reason in ``error``, and the pages after it are read. A
    null file, or one whose chain of directories is broken, gives a row with page null and the reason, beside the
    pages before it. Repeated rows give repeated pages. Only the two columns named are read.
    """
    kind = files.schema[id_col].dataType.simpleString()

    def rows(data: bytes | None) -> Iterator[tuple]:
        if data is None:
            yield (None, None, *[None] * 7, "no file")
            return
        digest = hashlib.sha256(data).hexdigest()
        try:
            for k, ifd in enumerate(directories(data)):
                try:
                    got = page_samples(data, ifd)
                except (TiffError, zlib.error, struct.error, TypeError, ValueError) as e:  # a page may hold anything
                    yield (len(data), digest, k, *[None] * 6, str(e))
                    continue
                yield (len(data), digest, k, got.shape[1], got.shape[0], got.shape[2], ifd.get(COMPRESSION, (NONE,))[0], ifd.get(PREDICTOR, (1,))[0], got.tobytes(), None)
        except (TiffError, struct.error) as e:
            yield (len(data), digest, *[None] * 7, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), *[pa.int32()] * 6, pa.binary(), pa.string()]
        names = ["id", "media_bytes", "media_sha256", "page", "width", "height", "samples_per_pixel", "compression", "predictor", "samples", "error"]
        for b in slices(batches, 128):
            ids, made = [], []
            for key, data in zip(column(b, "id"), column(b, "media"), strict=True):
                for row in rows(data):
                    ids.append(key)
                    made.append(row)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("id").type), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True))], names)

    return files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, media_bytes long, media_sha256 string, {PAGE_SCHEMA}")


#: Samples in a row of the images that hold texts; a payload is padded to whole rows.
TEXT_WIDTH = 64


def texts_to_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """(id, n_bytes, media): each whole text as UTF-8, padded with zero bytes to a positive number of rows, as a one-page TIFF.

    Null and empty texts are one row of zero bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            sizes, media = [], []
            for text in column(b, "t"):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                sizes.append(len(raw))
                raw += b"\0" * (-len(raw) % TEXT_WIDTH if raw else TEXT_WIDTH)
                media.append(encode_tiff([np.frombuffer(raw, np.uint8).reshape(-1, TEXT_WIDTH)], compression, predictor))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def feature_of(samples: bytes) -> str:
    """Mean, largest sample and number of distinct samples."""
    a = np.frombuffer(samples, np.uint8)
    hist = np.bincount(a, minlength=256)
    return f"mean={int(a.sum(dtype=np.int64)) * 1000 // max(1, a.size)},max={int(a.max(initial=0))},distinct={int((hist > 0).sum())}"


def page_features(pages: DataFrame, text_sizes: bool = True) -> DataFrame:
    """Digests and features of single-page images, read back: the columns of the payload contract.

    A page that could not be read has a null payload and its reason in ``error``. An empty table gives an empty one; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            raws = column(b, "samples")
            sizes = [x and len(x) for x in raws]
            made = [
                pa.array(sizes, pa.int64()),
                pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in raws], pa.string()),
                pa.array([None if x is None else zlib.crc32(x[-TEXT_WIDTH:]) for x in raws], pa.int64()),
                pa.array([None if x is None else feature_of(x) for x in raws], pa.string()),
            ]
            keep = ["id", "n_bytes", "media_bytes", "media_sha256", "error"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *made], [*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.select("id", "n_bytes", "media_bytes", "media_sha256", "samples", "error").mapInArrow(run, f"id {kind}, n_bytes long, media_bytes long, media_sha256 string, error string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
