import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from websource_audit.llm import tiff


@pytest.mark.parametrize("size", [0, 1, 127, 128, 129, 5000])
def test_pack_bits_and_lzw_round_trip(size):
    rnd = random.Random(size)
    for data in (bytes(rnd.randrange(256) for _ in range(size)), b"ab" * (size // 2) + b"c" * (size % 2), bytes(size)):
        assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_past_table_resets():
    data = np.random.default_rng(1).integers(0, 256, 60_000, np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
def test_pages_round_trip(spark, compression, predictor, tile):
    rng = np.random.default_rng(7)
    pages = [rng.integers(0, 256, (37, 21), np.uint8), np.zeros((1, 64), np.uint8), rng.integers(0, 4, (40, 64), np.uint8)]
    file = tiff.encode_tiff(pages, compression, predictor, rows_per_strip=8, tile=tile)
    got = tiff.tiff_pages(spark.createDataFrame([(5, file)], "k long, f binary"), "k", "f").orderBy("page").collect()
    assert [(r.page, r.height, r.width) for r in got] == [(k, *p.shape) for k, p in enumerate(pages)]
    assert [bytes(r.samples) for r in got] == [p.tobytes() for p in pages]


def test_bad_files_give_an_error_row(spark):
    good = tiff.encode_tiff([np.ones((64, 64), np.uint8)])
    loop = bytearray(good)
    loop[-4:] = good[4:8]
    rows = [(1, None), (2, b""), (3, b"II*\0"), (4, good[:-8]), (5, bytes(loop)), (6, good)]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "k long, f binary"), "k", "f").collect()
    assert {r.id for r in got if r.error} == {1, 2, 3, 4, 5}
    assert [r.page for r in got if r.id == 6] == [0]


def field(file, tag, value=None, count=None):
    """The file with a field of its first directory changed."""
    out = bytearray(file)
    (at,) = struct.unpack_from("<I", out, 4)
    (n,) = struct.unpack_from("<H", out, at)
    for k in range(at + 2, at + 2 + 12 * n, 12):
        if struct.unpack_from("<H", out, k)[0] == tag:
            if count is not None:
                struct.pack_into("<I", out, k + 4, count)
            if value is not None:
                struct.pack_into("<I", out, k + 8, value)
    return bytes(out)


def test_bad_pages_do_not_end_the_file(spark):
    good = tiff.encode_tiff([np.ones((64, 64), np.uint8), np.zeros((8, 64), np.uint8)])
    rows = [(1, field(good, tiff.WIDTH, count=0)), (2, field(good, tiff.WIDTH, value=2**32 - 1)), (3, field(good, tiff.BITS, value=16)), (4, field(good, tiff.ROWS_PER_STRIP, value=0)), (5, field(good, tiff.STRIP_BYTES, value=1)), (6, field(good, tiff.SAMPLES, value=0))]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "k long, f binary"), "k", "f").collect()
    for k, _ in rows:
        own = sorted((r for r in got if r.id == k), key=lambda r: r.page)
        assert [r.page for r in own] == [0, 1] and own[0].error and own[1].error is None and (own[1].height, own[1].width) == (8, 64)


def test_text_contract(spark, documents):
    texts = [None, "", "a" * 64, "é" * 40, "x" * 70_000, "same", "same"]
    files = tiff.texts_to_tiff(documents(texts))
    pages = tiff.tiff_pages(files, "id", "media").join(files.select("id", "n_bytes"), "id")
    rows = {r.id: r for r in tiff.page_features(pages).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[5][1:] == rows[6][1:]
    assert tiff.page_features(pages.limit(0)).count() == 0


def test_a_claim_beyond_what_strips_hold_is_refused():
    data = bytearray(tiff.encode_tiff([np.zeros((4, 64), np.uint8)], tiff.DEFLATE, 2))
    (ifd,) = tiff.directories(bytes(data))
    with pytest.raises(tiff.TiffError, match="can hold"):
        tiff.page_samples(bytes(data), ifd | {tiff.HEIGHT: (1 << 30,), tiff.ROWS_PER_STRIP: (1 << 30,)})


def test_samples_beyond_256_million():
    rows = (1 << 22) + 1
    data = tiff.encode_tiff([np.zeros((rows, 64), np.uint8)], tiff.DEFLATE, 1)
    (ifd,) = tiff.directories(data)
    assert tiff.page_samples(data, ifd).shape == (rows, 64, 1)


def test_errors_reach_the_features(spark):
    pages = spark.createDataFrame([(None, 3, 9, "d", None, "bad"), (2, 3, 9, "d", b"abc", None)], "id long, n_bytes long, media_bytes long, media_sha256 string, samples binary, error string").selectExpr("*", "1 as feature")
    out = {r.id: r for r in tiff.page_features(pages).collect()}
    assert out[None].error == "bad" and out[None].payload_sha256 is None and out[2].error is None and out[2].payload_bytes == 3
    assert tiff.page_features(pages.limit(0)).count() == 0
