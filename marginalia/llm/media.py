"""Media columns: texts stored losslessly as baseline JPEGs, read back by a marker parser and a Huffman decoder.

A payload byte is one quantised coefficient of an 8 x 8 block. A coefficient of size category 8 holds exactly
256 values whose extra bits are the byte itself, so no byte is lost and any baseline decoder can read the file.
Each block is a restart interval of its own: all intervals of a batch are decoded in lock step in numpy, and a lost
byte harms one block. The decoder itself reads any greyscale or interleaved baseline file; files without restart
intervals are one interval each.

Null text counts as empty. An empty text gives 576 bytes of 255. Equal texts give equal files and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, prepare, slices

UNIT = 576
#: Fixed values of the format: the order in which a block's 64 coefficients are stored.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: Blocks that are decoded at a time.
BLOCKS_AT_ONCE = 1 << 14
_MOST_SIDE = 8191


def pad(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def encode(payload: bytes) -> bytes:
    """A greyscale baseline JPEG that holds payload (a multiple of 64 bytes) as its coefficients."""
    n = len(payload) // 64
    cols = 9
    while -(-n // cols) > _MOST_SIDE:
        cols *= 2
    rows = -(-n // cols)
    data = np.frombuffer(payload, np.uint8)
    if rows * cols > n:  # the last row of blocks of a very long payload; the comment says what is payload
        data = np.concatenate([data, np.full((rows * cols - n) * 64, 255, np.uint8)])
    head = b"\xff\xd8" + _segment(0xFE, struct.pack(">Q", len(payload))) + _segment(0xDB, b"\x00" + b"\x01" * 64)
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, cols * 8, 1, 1, 0x11, 0))
    for kind in (0x00, 0x10):  # one code of one bit, for size category 8 without a run of zeros
        head += _segment(0xC4, bytes([kind, 1, *[0] * 15, 8]))
    head += _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    out = [head]
    total = rows * cols
    for a in range(0, total, BLOCKS_AT_ONCE):
        out.append(_scan(data[a * 64 : (a + BLOCKS_AT_ONCE) * 64], a, total))
    return b"".join([*out, b"\xff\xd9"])


def _scan(data: np.ndarray, first: int, total: int) -> bytes:
    n = len(data) // 64
    bits = np.zeros((n, 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(data.reshape(n, 64, 1), axis=2)
    packed = np.packbits(bits.reshape(n, 576), axis=1)
    marks = np.empty((n, 74), np.uint8)
    marks[:, :72] = packed
    marks[:, 72] = 255
    marks[:, 73] = 0xD0 + (np.arange(first, first + n) & 7)
    stuffed = np.ones((n, 74), np.int64)
    stuffed[:, :72] += packed == 255
    flat, times = marks.ravel(), stuffed.ravel()
    if first + n == total:  # no restart after the last block
        flat, times = flat[:-2], times[:-2]
    out = np.zeros(int(times.sum()), np.uint8)
    out[np.cumsum(times) - times] = flat
    return out.tobytes()


@dataclass
class Image:
    """What the markers say, then the decoded coefficients of the first component in block order."""

    width: int = 0
    height: int = 0
    payload_bytes: int | None = None
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    restart: int = 0
    scan: tuple[int, list[tuple[int, int]]] = (0, [])


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 next bits: code length times 256 plus symbol; 0 where no code matches."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            low = code << (16 - length)
            table[low : low + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def parse(data: bytes) -> Image:
    """Read the markers up to the scan. ValueError: not a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    out, at = Image(), 2
    while True:
        if at + 4 > len(data) or data[at] != 255:
            raise ValueError("broken marker")
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out.codes[body[0]] = (body[1:17], body[17 : 17 + n])
                out.tables[body[0]] = _lookup(*out.codes[body[0]])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE and len(body) == 8:
            out.payload_bytes = struct.unpack(">Q", body)[0]
        elif marker == 0xDA:
            out.scan = (at, [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])])
            return out


def _intervals(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing, and where each restart interval starts and ends."""
    raw = np.frombuffer(data, np.uint8)[at:]
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    stop = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255)]
    end = int(stop[0]) if len(stop) else len(raw)
    ff, after = ff[ff < end], after[ff < end]
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    clean = raw[:end][keep]
    left = np.cumsum(keep)
    cuts = np.concatenate([[0], left[marks], [len(clean)]])
    return clean, cuts


@dataclass
class _Scan:
    image: Image
    units: list[tuple[int, int, int]]  # component, DC table, AC table of each block of an MCU
    mine: list[int]
    clean: np.ndarray
    cuts: np.ndarray
    counts: np.ndarray  # MCUs of each interval
    key: tuple


def _scan_of(data: bytes) -> _Scan:
    image = parse(data)
    at, parts = image.scan
    shape = {c[0]: c for c in image.components}
    units: list[tuple[int, int, int]] = []
    for cid, tables in parts:
        _, h, v, _ = shape[cid]
        units += [(cid, tables >> 4, 0x10 | tables & 15)] * (1 if len(parts) == 1 else h * v)
    top_h, top_v = (1, 1) if len(parts) == 1 else (max(c[1] for c in image.components), max(c[2] for c in image.components))
    mcus = -(-image.width // (8 * top_h)) * -(-image.height // (8 * top_v))
    clean, cuts = _intervals(data, at)
    per = image.restart or mcus
    n = -(-mcus // per)
    if len(cuts) - 1 < n:
        raise ValueError("scan ends early")
    counts = np.minimum(per, mcus - np.arange(n) * per)
    key = (tuple(units), *((t, image.codes[t]) for t in sorted({x for u in units for x in u[1:]})))
    return _Scan(image, units, [i for i, u in enumerate(units) if u[0] == parts[0][0]], clean, cuts[: n + 1], counts, key)


def decode(data: bytes) -> tuple[Image, np.ndarray]:
    """The image's markers, and its first component's coefficients: blocks in coded order x 64 in zigzag order."""
    return decode_all([data])[0]


def decode_all(files: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """decode() of each file; the intervals of files with the same Huffman tables go in lock step, so many at a time."""
    scans = [_scan_of(f) for f in files]
    outs = [np.zeros((int(s.counts.sum()), len(s.mine), 64), np.int16) for s in scans]
    groups: dict[tuple, list[int]] = {}
    for i, s in enumerate(scans):
        groups.setdefault(s.key, []).append(i)
    for members in groups.values():
        todo: list[tuple[int, int, int]] = []  # file, its first and last interval
        size = 0
        for i in members:
            n, a = len(scans[i].counts), 0
            while a < n:
                b = min(n, a + max(1, BLOCKS_AT_ONCE - size))
                todo.append((i, a, b))
                size, a = size + b - a, b
                if size >= BLOCKS_AT_ONCE:
                    _together(scans, outs, todo)
                    todo, size = [], 0
        if todo:
            _together(scans, outs, todo)
    return [(s.image, o.reshape(-1, 64)) for s, o in zip(scans, outs, strict=True)]


def _together(scans: list[_Scan], outs: list[np.ndarray], todo: list[tuple[int, int, int]]) -> None:
    parts, starts, ends, counts, at = [], [], [], [], 0
    for i, a, b in todo:
        s = scans[i]
        parts.append(s.clean[s.cuts[a] : s.cuts[b]])
        starts.append(s.cuts[a:b] - s.cuts[a] + at)
        ends.append(s.cuts[a + 1 : b + 1] - s.cuts[a] + at)
        counts.append(s.counts[a:b])
        at += len(parts[-1])
    one = scans[todo[0][0]]
    counts = np.concatenate(counts)
    out = np.zeros((int(counts.sum()), len(one.mine), 64), np.int16)
    _lockstep(np.concatenate(parts), np.concatenate(starts), np.concatenate(ends), counts, one.image.tables, one.units, one.mine, out)
    at = 0
    for i, a, b in todo:
        s = scans[i]
        before, n = int(s.counts[:a].sum()), int(s.counts[a:b].sum())
        outs[i][before : before + n] = out[at : at + n]
        at += n


def _lockstep(clean, starts, ends, counts, tables, units, mine, out) -> None:
    """Decode one coefficient of every interval at a time. out: blocks of the wanted component, interval after interval."""
    n = len(starts)
    part = np.concatenate([clean, np.full(8, 255, np.uint8)])
    window = np.zeros(len(part) - 5, np.uint64)
    for j in range(5):
        window = window << np.uint64(8) | part[j : len(part) - 5 + j]
    limit, top = len(window) - 1, ends * 8
    bit = starts * 8
    level = {u[0]: np.zeros(n, np.int64) for u in units}
    every, base = np.arange(n), np.cumsum(counts) - counts

    def symbol(table, who, pos):
        got = window[np.minimum(pos >> 3, limit)]
        near = ((got >> (np.uint64(24) - (pos & 7).astype(np.uint64))) & np.uint64(0xFFFF)).astype(np.int64)
        found = table[near]
        if not found.all():
            raise ValueError("no such code")
        return found & 255, pos + (found >> 8)

    def extra(size, pos):
        got = window[np.minimum(pos >> 3, limit)]
        bits = ((got >> (np.uint64(40) - (pos & 7).astype(np.uint64) - size.astype(np.uint64))) & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where((size > 0) & (bits < 1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)

    for m in range(int(counts.max())):
        live = every[counts > m]
        where = base[live] + m
        for u, (cid, dc, ac) in enumerate(units):
            size, pos = symbol(tables[dc], live, bit[live])
            value = level[cid][live] + extra(size, pos)
            level[cid][live] = value
            pos = pos + size
            slot = mine.index(u) if u in mine else -1
            if slot >= 0:
                out[where, slot, 0] = value
            act, row, k = live, where, np.ones(len(live), np.int64)
            while len(act):
                rs, after = symbol(tables[ac], act, pos)
                run, size = rs >> 4, rs & 15
                k = k + run
                if slot >= 0:
                    put = size > 0
                    if put.all():
                        out[row, slot, k] = extra(size, after)
                    else:
                        out[row[put], slot, k[put]] = extra(size[put], after[put])
                pos = after + size
                k = k + 1
                end = (k > 63) | ((size == 0) & (run < 15))
                if end.any():
                    bit[act[end]] = pos[end]
                    go = ~end
                    act, row, k, pos = act[go], row[go], k[go], pos[go]
    if (bit > top + 7).any():
        raise ValueError("interval ends early")


def payload_of(image: Image, blocks: np.ndarray) -> bytes:
    """The stored bytes: of a size-8 coefficient its extra bits."""
    values = np.where(blocks < 0, blocks + 255, blocks).astype(np.uint8)
    values = values.tobytes()
    return values if image.payload_bytes is None else values[: image.payload_bytes]


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """DC-only luminance, one pixel a block, for images of one block an MCU row by row."""
    q = image.quant[image.components[0][3]][0]
    cols, rows = -(-image.width // 8), -(-image.height // 8)
    return np.clip(blocks[: rows * cols, 0].astype(np.float64) * q / 8 + 128, 0, 255).reshape(rows, cols)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64-bit difference hash of the thumbnail averaged to 8 x 9, as hex."""

    def shrink(a: np.ndarray, n: int) -> np.ndarray:
        at = np.arange(n) * len(a) // n
        to = np.maximum(at + 1, (np.arange(n) + 1) * len(a) // n)
        sums = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a, 0)])
        return (sums[to] - sums[at]) / (to - at)[:, None]

    small = shrink(shrink(pixels, 8).T, 9).T
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def describe(text: bytes) -> tuple:
    """Store, read back, and describe one text."""
    return describe_all([text])[0]


def describe_all(texts: list[bytes]) -> list[tuple]:
    """Store, read back, and describe texts."""
    files = [encode(pad(t)) for t in texts]
    out = []
    for text, media, (image, blocks) in zip(texts, files, decode_all(files), strict=True):
        payload = payload_of(image, blocks)
        feature = f"{image.width}x{image.height}:{thumbnail_hash(thumbnail(image, blocks))}"
        out.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, image.width, image.height))
    return out


def with_media(df: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """df and a binary column with each text's JPEG; a column of that name is replaced."""
    prepare(df.sparkSession)
    keep = df.drop(to)
    schema = extended(keep.schema, **{to: "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [encode(pad((t or "").encode())) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(media, pa.binary())], [*b.schema.names, to])

    return keep.mapInArrow(run, schema)


def media_features(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the digest columns of each text's stored form. Files of one block an MCU share a lock step."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for b in batches:
            found = []
            for x, y, buf, offsets in slices(b.column(1)):
                found += describe_all([buf[offsets[i] : offsets[i + 1]].tobytes() for i in range(y - x)])
            columns = list(zip(*found, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, types[1:], strict=True)]], names)

    return df.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, SCHEMA)
