import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import jpeg


def laid(texts):
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return np.frombuffer(b"".join(texts), np.uint8), offsets


@pytest.mark.parametrize("texts", [[b""], [b"a" * 63, b"", b"b" * 64, b"c" * 65], [bytes(range(256)) * 5, b"\xff" * 300, b"\x00\xff" * 100]])
def test_round_trip(texts):
    payload, to = jpeg.padded(*laid(texts))
    media, at = jpeg.encode(payload, to)
    for k, found in enumerate(jpeg.thumbnails(media, at)):
        assert found[2].tobytes() == texts[k] + b"\0" * (len(found[2].ravel()) - len(texts[k]))
        assert found[0] == 512 and found[1] == len(found[2]) * 8


def test_random_and_long():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (1, 1000, 70_000, jpeg.ROWS * 64 + 130)]
    media, at = jpeg.encode(*jpeg.padded(*laid(texts)))
    assert all(f[2].tobytes().rstrip(b"\0") == t.rstrip(b"\0") for f, t in zip(jpeg.thumbnails(media, at), texts))


def bits_of(blocks, tables):
    """A slow writer: blocks are (component, DC difference, [(run, value), ...])."""
    out = ""
    for c, d, acs in blocks:
        def put(kind, run, v):
            nonlocal out
            s = abs(v).bit_length()
            code, n = jpeg.canonical(tables[kind | c])[run << 4 | s]
            out += f"{code:0{n}b}" + (f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else "")
        put(0, 0, d)
        for run, v in acs:
            put(16, run, v)
        if sum(r + 1 for r, _ in acs) < 63:
            put(16, 0, 0)
    out += "1" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8).replace(b"\xff", b"\xff\0")


def test_colour_subsampled_with_ac_and_no_restarts():
    tables = {0: {k: 4 for k in range(12)}, 1: {k: 4 for k in range(12)}, 16: {s: 8 for s in range(250)}, 17: {s: 8 for s in range(250)}}
    rng = np.random.default_rng(2)
    across, down = 3, 2  # MCUs of 16 x 16: 2 x 2 luminance blocks and one of each colour
    luma = rng.integers(-500, 500, (down * 2, across * 2))
    blocks, last = [], 0
    for m in range(across * down):
        for v in (0, 1):
            for h in (0, 1):
                x = int(luma[m // across * 2 + v, m % across * 2 + h])
                blocks.append((0, x - last, [(3, 5), (0, -2), (15, 0), (2, 1)] if h else [(0, 1)] * 63))
                last = x
        blocks += [(1, 0, []), (1, 0, [(1, 7)])]
    import struct

    q = [4] + [9] * 63
    head = b"\xff\xd8" + jpeg._segment(0xE0, b"JFIF\0") + jpeg._segment(0xDB, bytes([0, *q]))
    head += jpeg._segment(0xC0, struct.pack(">BHHB9B", 8, 30, 45, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    head += b"".join(jpeg._dht(k, t) for k, t in tables.items()) + jpeg._segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))
    media = head + bits_of(blocks, tables) + b"\xff\xd9"
    ((width, height, pixels),) = jpeg.thumbnails(*laid([media]))
    assert (width, height) == (45, 30)
    want = np.clip(np.floor(luma * 4 / 8 + 128.5), 0, 255)
    assert (pixels == want[:4, :6]).all()


@pytest.mark.parametrize("bad", [b"", b"hello", b"\xff\xd8\xff\xd9", jpeg.header(1), jpeg.header(1) + b"\xff\xd9", jpeg.header(3).replace(b"\xff\xc0", b"\xff\xc2")])
def test_what_is_no_baseline_jpeg(bad):
    assert isinstance(jpeg.thumbnails(*laid([bad]))[0], str)


def test_query(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 1000), (5, "x" * 1000), (5, "x" * 1000), (None, "y")]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, media string, n_bytes int")
    got = jpeg.digest(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[4].media_sha256 == by[5].media_sha256 and by[4].feature == by[5].feature and by[2].feature == by[3].feature
    assert jpeg.digest(df.limit(0)).count() == 0
    assert jpeg.read(spark.createDataFrame([(1, bytearray(b"zz")), (2, None)], "id long, media binary")).where(F.col("error").isNull()).count() == 0
