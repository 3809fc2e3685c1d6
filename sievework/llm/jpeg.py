"""Media columns: baseline JPEG in numpy.

pack() stores bytes losslessly as the quantised DC coefficients of a grey image, one byte a block, 64 blocks a row.
read() parses markers, decodes the Huffman scans of any baseline JPEG and rebuilds the DC-only luminance thumbnail;
with the quantiser 8 that pack() writes, a thumbnail's pixel is the DC coefficient plus 128, the stored byte itself.
All restart segments of a slice are decoded in step, one symbol of each at a time."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import binaries, map_slices, ranges, table

#: Bytes in a row of blocks, which is a restart segment; an image has 8191 rows of blocks at most, more bytes make more images.
ROW = 64
ROWS = 8191
#: Code lengths of the DC categories 0 to 8 (differences of text bytes are mostly of 4 to 7 bits) and the only AC symbol, end of block.
DC_LENGTHS = {6: 2, 4: 3, 5: 3, 7: 3, 0: 4, 3: 4, 1: 5, 2: 5, 8: 5}
EOB = 0
#: Where the k-th coefficient of a zigzag scan lies is not needed: only the DC coefficient is rebuilt.
MEDIA_BYTES = 4 << 20


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length), shorter codes first, as the JPEG standard derives them from counts."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: x[1])
    return _segment(0xC4, bytes([kind] + [sum(n == k for _, n in order) for k in range(1, 17)] + [s for s, _ in order]))


def header(rows: int, wide: int = ROW) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0, 8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, wide * 8, 1, 1, 0x11, 0))
        + _dht(0x00, DC_LENGTHS)
        + _dht(0x10, {EOB: 1})
        + _segment(0xDD, struct.pack(">H", wide))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


_CODE = np.zeros(9, np.int64)
_LEN = np.zeros(9, np.int64)
for _s, (_c, _n) in canonical(DC_LENGTHS).items():
    _CODE[_s], _LEN[_s] = _c, _n
_CATEGORY = np.array([int(x).bit_length() for x in range(256)], np.int64)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with bytes 0 up to a positive multiple of ROW."""
    lengths = np.diff(offsets)
    full = np.maximum(-(-lengths // ROW), 1) * ROW
    to = np.concatenate(([0], np.cumsum(full)))
    out = np.zeros(int(to[-1]), np.uint8)
    out[ranges(to[:-1], lengths)] = data
    return out, to


def encode(payload: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads (multiples of ROW bytes each) -> JPEG bytes laid end to end, and their offsets."""
    dc = payload.reshape(-1, ROW).astype(np.int64) - 128
    diff = np.diff(dc, axis=1, prepend=0)
    size = _CATEGORY[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    bits = _LEN[size] + size + 1
    value = ((_CODE[size] << size) | extra) << 1
    ends = np.cumsum(bits, axis=1)
    n_bytes = -(-ends[:, -1] // 8)
    # the last byte of a segment is filled with ones
    fill = n_bytes * 8 - ends[:, -1]
    value[:, -1] = (value[:, -1] << fill) | ((1 << fill) - 1)
    bits[:, -1] += fill
    ends[:, -1] += fill
    base = np.concatenate(([0], np.cumsum(n_bytes)))
    total = int(base[-1])
    at = (base[:-1, None] * 8 + ends - bits).ravel()
    value = value.ravel() << (32 - (at & 7) - bits.ravel())
    first = at >> 3
    raw = np.zeros(total + 4, np.int64)
    for k in range(4):
        raw += np.bincount(first + k, weights=(value >> (24 - 8 * k)) & 255, minlength=total + 4).astype(np.int64)
    raw = raw[:total].astype(np.uint8)
    # stuffing: a zero after each 255; then markers between a picture's segments
    stuffed = raw == 255
    shift = np.cumsum(stuffed) - stuffed
    parts, sizes = [], np.zeros(len(to) - 1, np.int64)
    body = np.zeros(total + int(stuffed.sum()), np.uint8)
    body[np.arange(total) + shift] = raw
    seg = np.concatenate((base[:-1] + shift[base[:-1]], [len(body)])) if total else np.zeros(1, np.int64)
    lengths = np.diff(seg)
    # all segments with the two bytes that follow each: RSTm, or EOI after the last of a picture
    rows = np.diff(to) // ROW
    row_of = np.concatenate([np.arange(r) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    in_image = row_of % ROWS
    last = np.zeros(len(row_of), bool)
    last[np.cumsum(rows) - 1] = True
    last |= in_image == ROWS - 1
    place = np.concatenate(([0], np.cumsum(lengths + 2)))
    out = np.zeros(int(place[-1]), np.uint8)
    out[ranges(place[:-1], lengths)] = body
    out[place[1:] - 2] = 0xFF
    out[place[1:] - 1] = np.where(last, 0xD9, 0xD0 + (in_image & 7))
    first_row = np.concatenate(([0], np.cumsum(rows)))
    for d in range(len(rows)):
        mine = 0
        for r in range(0, int(rows[d]), ROWS):
            k = min(ROWS, int(rows[d]) - r)
            lo, hi = place[first_row[d] + r], place[first_row[d] + r + k]
            parts.append(head := header(k))
            parts.append(out[lo:hi].tobytes())
            mine += len(head) + int(hi - lo)
        sizes[d] = mine
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


@dataclass
class Picture:
    """What the markers of one picture say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quant: dict[int, int] = field(default_factory=dict)  # the DC entry of each table
    huffman: dict[int, tuple] = field(default_factory=dict)  # class << 4 | id -> ((length, symbol), ...)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC table, AC table
    restart: int = 0
    data: tuple[int, int] = (0, 0)


def parse(media: bytes) -> list[Picture]:
    """The pictures in a byte string: baseline (SOF0, or SOF1 of 8 bits), one interleaved scan each; else ValueError."""
    out, i, n = [], 0, len(media)
    p = None
    while i + 1 < n:
        if media[i] != 0xFF:
            raise ValueError("marker expected")
        m = media[i + 1]
        i += 2
        if m == 0xD8:
            p = Picture()
            continue
        if m == 0xFF or m == 0xD9:
            i -= m == 0xFF
            continue
        if p is None or i + 2 > n:
            raise ValueError("no picture")
        size = struct.unpack_from(">H", media, i)[0]
        body = media[i + 2 : i + size]
        i += size
        if m == 0xDB:
            while body:
                wide = body[0] >> 4
                p.quant[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[1 + 64 * (1 + wide) :]
        elif m in (0xC0, 0xC1):
            bits, p.height, p.width, k = struct.unpack_from(">BHHB", body)
            if bits != 8 or not (p.width and p.height and k):
                raise ValueError("8-bit samples and known dimensions only")
            p.components = [(body[6 + 3 * j], body[7 + 3 * j] >> 4, body[7 + 3 * j] & 15, body[8 + 3 * j]) for j in range(k)]
        elif 0xC2 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif m == 0xC4:
            while body:
                counts = body[1:17]
                symbols = body[17 : 17 + sum(counts)]
                lengths = [length for length, c in enumerate(counts, 1) for _ in range(c)]
                p.huffman[body[0]] = tuple(zip(lengths, symbols, strict=True))
                body = body[17 + len(symbols) :]
        elif m == 0xDD:
            p.restart = struct.unpack(">H", body[:2])[0]
        elif m == 0xDA:
            p.scan = [(body[1 + 2 * j], body[2 + 2 * j] >> 4, body[2 + 2 * j] & 15) for j in range(body[0])]
            if len(p.scan) != len(p.components) or not p.components:
                raise ValueError("one interleaved scan expected")
            end = i
            while True:
                end = media.find(b"\xff", end)
                if end < 0 or end + 1 >= n:
                    end = n
                    break
                if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            p.data = (i, end)
            i = end
            out.append(p)
            p = None
    if not out:
        raise ValueError("no picture")
    return out


def lookup(codes: tuple) -> np.ndarray:
    """65,536 entries: length << 8 | symbol of the code that 16 bits begin with; 0 where there is none."""
    out, code, last = np.zeros(1 << 16, np.int64), 0, 0
    for length, symbol in codes:
        code <<= length - last
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
        code, last = code + 1, length
    return out




def _decode_group(data: np.ndarray, pictures: list[Picture]) -> list[np.ndarray]:
    """DC coefficients of the first component of pictures that share tables and components, as rows x columns of blocks."""
    p = pictures[0]
    h_max, v_max = max(c[1] for c in p.components), max(c[2] for c in p.components)
    one = len(p.components) == 1
    tables = {c: (lookup(p.huffman[d]), lookup(p.huffman[16 | a])) for c, d, a in p.scan}
    block_of = [k for k, (c, h, v, _) in enumerate(p.components) for _ in range(1 if one else h * v)]
    # entropy-coded bytes of all pictures, segments cut at RSTm, stuffing removed
    spans = np.array([q.data for q in pictures], np.int64)
    lengths = spans[:, 1] - spans[:, 0]
    raw = data[ranges(spans[:, 0], lengths)]
    begin = np.concatenate(([0], np.cumsum(lengths)))
    ff = np.flatnonzero(raw[:-1] == 255) if len(raw) else np.zeros(0, np.int64)
    after = raw[ff + 1]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    at = np.concatenate(([0], np.cumsum(keep)))
    cuts = np.sort(np.concatenate((begin[:-1], marks + 2)))
    seg_start = at[cuts]
    clean = raw[keep]
    wide = np.concatenate((clean, np.full(8, 255, np.uint8))).astype(np.int64)
    n = len(clean) + 3
    window = wide[:n] << 32 | wide[1 : n + 1] << 24 | wide[2 : n + 2] << 16 | wide[3 : n + 3] << 8 | wide[4 : n + 4]
    # how many MCUs each segment has
    mcus, first_seg, counts = [], [], []
    per = np.searchsorted(cuts, begin)
    for k, q in enumerate(pictures):
        across = -(-q.width // (8 * (1 if one else h_max)))
        down = -(-q.height // (8 * (1 if one else v_max)))
        total, segs = across * down, int(per[k + 1] - per[k])
        step = q.restart or total
        if segs != -(-total // step):
            raise ValueError("restart markers do not match the dimensions")
        counts.append(np.minimum(step, total - step * np.arange(segs)))
        mcus.append((across, down))
        first_seg.append(int(per[k]))
    count = np.concatenate(counts)
    order = np.argsort(-count, kind="stable")
    pos = seg_start[order] * 8
    count = count[order]
    most = int(count[0])
    predicted = np.zeros((len(p.components), len(order)), np.int64)
    luma = block_of.count(0)
    got = np.zeros((most * luma, len(order)), np.int32)
    limit = len(clean) * 8
    row = 0
    for m in range(most):
        live = int(np.searchsorted(-count, -m, "left"))
        at_ = pos[:live]
        for b in block_of:
            dc, ac = tables[p.components[b][0]]
            w = window[np.minimum(at_ >> 3, n - 1)]
            left = 24 - (at_ & 7)
            code = dc[(w >> left) & 0xFFFF]
            if (code == 0).any():
                raise ValueError("no such code")
            size = code & 255
            used = (code >> 8) + size
            value = (w >> (40 - (at_ & 7) - used)) & ((1 << size) - 1)
            value += ((value >> np.maximum(size - 1, 0)) == 0) * (1 - (1 << size)) * (size > 0)
            predicted[b, :live] += value
            at_ += used
            if b == 0:
                got[row, :live] = predicted[0, :live]
                row += 1
            # AC symbols are stepped over until each block's end
            w = window[np.minimum(at_ >> 3, n - 1)]
            code = ac[(w >> (24 - (at_ & 7))) & 0xFFFF]
            at_ += code >> 8
            going = np.flatnonzero((code & 255) != EOB)
            if (code == 0).any():
                raise ValueError("no such code")
            if len(going):
                symbol = code[going] & 255
                at_[going] += symbol & 15
                k = np.ones(len(going), np.int64) + (symbol >> 4) + 1
                going, k = going[k < 64], k[k < 64]
                while len(going):
                    a = at_[going]
                    code = ac[(window[np.minimum(a >> 3, n - 1)] >> (24 - (a & 7))) & 0xFFFF]
                    if (code == 0).any():
                        raise ValueError("no such code")
                    symbol = code & 255
                    at_[going] = a + (code >> 8) + (symbol & 15)
                    k = np.where(symbol == EOB, 64, k + (symbol >> 4) + 1)
                    going, k = going[k < 64], k[k < 64]
    if (pos > limit).any():
        raise ValueError("scan ends early")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    out = []
    _, h, v, _ = p.components[0]
    for k, q in enumerate(pictures):
        across, down = mcus[k]
        cols = back[first_seg[k] : first_seg[k] + len(counts[k])]
        dcs = got[:, cols].T.reshape(len(cols), most, luma)
        flat = np.concatenate([d[: counts[k][j]] for j, d in enumerate(dcs)]) if (counts[k] != most).any() else dcs.reshape(-1, luma)
        if one:
            grid = flat.reshape(down, across)
        else:
            grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            grid = grid[: -(-q.height * v // (8 * v_max)), : -(-q.width * h // (8 * h_max))]
        out.append(grid)
    return out


def thumbnails(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, np.ndarray] | str]:
    """For each row of JPEG bytes its width, height and DC-only luminance thumbnail (several pictures of one width are
    stacked), or what is wrong with it."""
    rows: list = []
    groups: dict = defaultdict(list)
    for r in range(len(offsets) - 1):
        try:
            pictures = parse(data[offsets[r] : offsets[r + 1]].tobytes())
            if len({q.width for q in pictures}) > 1:
                raise ValueError("widths differ")
            for q in pictures:
                q.data = (q.data[0] + int(offsets[r]), q.data[1] + int(offsets[r]))
                groups[tuple(sorted(q.huffman.items())), tuple(q.components), tuple(q.scan)].append((r, q))
            rows.append(pictures)
        except (ValueError, IndexError, struct.error) as e:
            rows.append(str(e) or type(e).__name__)
    grids: dict[int, np.ndarray] = {}
    for members in groups.values():
        try:
            found = _decode_group(data, [q for _, q in members])
        except (ValueError, KeyError, IndexError):
            found = []  # one bad picture does not spoil the others
            for r, q in members:
                try:
                    found += _decode_group(data, [q])
                except (ValueError, KeyError, IndexError) as e:
                    found.append(None)
                    rows[r] = str(e) or type(e).__name__
        for (_, q), grid in zip(members, found, strict=True):
            if grid is not None:
                grids[id(q)] = grid
    out: list = []
    for pictures in rows:
        if isinstance(pictures, str):
            out.append(pictures)
            continue
        pixels = [np.clip(np.floor(grids[id(q)] * (q.quant.get(q.components[0][3], 1) / 8) + 128.5), 0, 255).astype(np.uint8) for q in pictures]
        out.append((pictures[0].width, sum(q.height for q in pictures), np.concatenate(pixels)))
    return out


def fingerprint(pixels: np.ndarray) -> str:
    """64 bits in hex: which of 8 x 8 cells are brighter than their mean. Cells are means; small pictures repeat rows or columns."""
    rows, cols = pixels.shape
    sums = np.zeros((rows + 1, cols + 1))
    np.cumsum(np.cumsum(pixels, 0, dtype=np.float64), 1, out=sums[1:, 1:])
    lo_r, lo_c = np.arange(8) * rows // 8, np.arange(8) * cols // 8
    hi_r, hi_c = np.maximum(lo_r + 1, np.arange(1, 9) * rows // 8), np.maximum(lo_c + 1, np.arange(1, 9) * cols // 8)
    cell = sums[np.ix_(hi_r, hi_c)] - sums[np.ix_(lo_r, hi_c)] - sums[np.ix_(hi_r, lo_c)] + sums[np.ix_(lo_r, lo_c)]
    cell /= np.outer(hi_r - lo_r, hi_c - lo_c)
    return np.packbits((cell > cell.mean()).ravel()).tobytes().hex()


def _pack(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    media, to = encode(*padded(data, offsets))
    return table(doc_id=part.column("doc_id").cast(pa.int64()), n_bytes=np.diff(offsets), media=binaries(media, to))


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8 bytes (null: none), zero-padded to a positive multiple of 64,
    as a baseline JPEG. One row per row of docs; equal texts have equal media; other columns are ignored."""
    return map_slices(docs.select("doc_id", "text"), _pack, "doc_id long, n_bytes long, media binary")


def _read(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    found = thumbnails(data, offsets)
    pick = lambda f: pa.array([None if isinstance(x, str) else f(x) for x in found])
    new = {
        "width": pick(lambda x: x[0]).cast(pa.int32()),
        "height": pick(lambda x: x[1]).cast(pa.int32()),
        "thumb_hash": pick(lambda x: fingerprint(x[2])).cast(pa.string()),
        "thumb_sha256": pick(lambda x: hashlib.sha256(x[2].tobytes()).hexdigest()).cast(pa.string()),
        "thumb_bytes": pick(lambda x: x[2].size).cast(pa.int64()),
        "tail_crc32": pick(lambda x: zlib.crc32(x[2].ravel()[-ROW:].tobytes())).cast(pa.int64()),
        "media_bytes": pa.array(np.diff(offsets)),
        "media_sha256": pa.array([hashlib.sha256(data[offsets[i] : offsets[i + 1]]).hexdigest() for i in range(part.num_rows)]),
        "error": pa.array([x if isinstance(x, str) else None for x in found], pa.string()),
    }
    return table(**{c: part.column(c) for c in part.schema.names if c != "media"}, **new)


def read(df: DataFrame) -> DataFrame:
    """Adds dimensions, hashes of the DC-only luminance thumbnail and of the media, from a binary column `media`, and drops
    that. What is not a baseline JPEG (null and empty included) has nulls and its reason in `error`."""
    added = "width int, height int, thumb_hash string, thumb_sha256 string, thumb_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, error string"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "media")
    return map_slices(df, _read, f"{kept}, {added}", "media", MEDIA_BYTES)


def digest(docs: DataFrame) -> DataFrame:
    """pack(), then read(): what the stored bytes give back."""
    return read(pack(docs)).select(
        "doc_id", "n_bytes", F.col("thumb_bytes").alias("payload_bytes"), F.col("thumb_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256",
        F.format_string("%dx%d:%s", "width", "height", "thumb_hash").alias("feature"), "width", "height",
    )
