"""Baseline JPEG media columns: a codec in numpy whose DC thumbnails carry the payload.

store() writes payload bytes as the DC coefficients of a grayscale baseline
JPEG: with a DC quantiser of 8 each 8x8 block is flat and its sample value is
the payload byte, so the image's 1/8 luminance thumbnail is the payload, byte
for byte. Every thumbnail row is a restart interval.

thumbnails() reads any baseline JPEG (Huffman, 8 bits, one interleaved scan,
any sampling factors): it parses the markers, then decodes the restart
intervals of all images that share tables and layout in lock-step, one numpy
lane each, and keeps the luminance DC values.

Text is taken whole; null is empty. A payload that needs more than ROWS rows is
stored as several images one after the other. Equal texts have equal values;
repeated rows are repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops
from .common import plain

#: Thumbnail columns, and rows of one image at most (both times 8 are below 65,536).
WIDTH, ROWS = 192, 4096

#: Huffman code lengths of the DC size categories 0 to 8 of our own files; AC has end-of-block only.
_DC_LENGTHS = {6: 2, 3: 3, 4: 3, 5: 3, 7: 3, 0: 4, 1: 4, 2: 4, 8: 5}


def _codes(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """DHT counts and symbols, and canonical codes {symbol: (code, length)}."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last if last else lengths[s]
        last = lengths[s]
        codes[s] = (code, last)
        counts[last - 1] += 1
        code += 1
    return counts, symbols, codes


_COUNTS, _SYMBOLS, _CODE = _codes(_DC_LENGTHS)
_AC_COUNTS, _AC_SYMBOLS = [1] + [0] * 15, [0]
# Code and bit count of each DC difference from -255 to 255, its magnitude bits and the one-bit end of block.
_diff = np.arange(-255, 256)
_size = np.array([int(abs(d)).bit_length() for d in _diff])
_extra = np.where(_diff < 0, _diff + (1 << _size) - 1, _diff)
_VALUE = np.array([((_CODE[s][0] << s) | int(x)) << 1 for s, x in zip(_size.tolist(), _extra)], np.uint32)
_BITS = np.array([_CODE[s][1] + s + 1 for s in _size.tolist()], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_QUANT = _segment(0xDB, bytes([0, 8] + [1] * 63))
_HUFF = _segment(0xC4, bytes([0x00, *_COUNTS, *_SYMBOLS])) + _segment(0xC4, bytes([0x10, *_AC_COUNTS, *_AC_SYMBOLS]))


def _image(grid: np.ndarray) -> bytes:
    """One JPEG whose DC thumbnail is the uint8 grid."""
    rows, cols = grid.shape
    diff = np.diff(grid.astype(np.int16), axis=1, prepend=np.int16(128)).ravel().astype(np.int64) + 255
    bits, value = _BITS[diff], _VALUE[diff]
    used = bits.reshape(rows, cols).sum(axis=1)
    size = (used + 7) // 8
    start = np.cumsum(np.r_[0, size[:-1]]) * 8
    at = np.repeat(start - np.cumsum(np.r_[0, used[:-1]]), cols) + np.cumsum(bits) - bits
    out = np.zeros(int(size.sum()) + 8, np.uint8)
    # A code has at most 14 bits: it touches at most three bytes.
    shifted = value.astype(np.uint32) << (24 - bits - (at & 7)).astype(np.uint32)
    for k in range(3):
        # Codes of one byte are neighbours and don't share bits: adding is or.
        out += np.bincount((at >> 3) + k, ((shifted >> np.uint32(16 - 8 * k)) & np.uint32(255)), len(out)).astype(np.uint8)
    out = out[:-8]
    end = np.cumsum(size)
    pad = (8 * size - used).astype(np.int64)
    out[end - 1] |= ((1 << pad) - 1).astype(np.uint8)
    # Stuff a zero after each 0xFF and put a restart marker after every interval but the last.
    gap = (out == 255).astype(np.int64)
    gap[end[:-1] - 1] += 2
    place = np.arange(len(out)) + np.cumsum(gap) - gap
    scan = np.zeros(len(out) + int(gap.sum()), np.uint8)
    scan[place] = out
    mark = place[end[:-1] - 1] + gap[end[:-1] - 1] - 1
    scan[mark] = 255
    scan[mark + 1] = 0xD0 + np.arange(rows - 1) % 8
    frame = struct.pack(">BHHBBBB", 8, rows * 8, cols * 8, 1, 1, 0x11, 0)
    head = b"\xff\xd8" + _QUANT + _segment(0xC0, frame) + _HUFF + _segment(0xDD, struct.pack(">H", cols)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    return head + scan.tobytes() + b"\xff\xd9"


def payload(text: bytes) -> bytes:
    """The bytes, filled with spaces up to a positive multiple of WIDTH."""
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


def store(data: bytes) -> bytes:
    grid = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return b"".join(_image(grid[i : i + ROWS]) for i in range(0, len(grid), ROWS))


class _Image:
    """Parsed headers of one image: layout key, and the bounds of its entropy-coded data."""

    def __init__(self, raw: bytes, at: int):
        if raw[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        quant, huff, interval, frame, i = {}, {}, 0, None, at + 2
        while True:
            while raw[i : i + 2] == b"\xff\xff":
                i += 1
            marker, size = raw[i + 1], int.from_bytes(raw[i + 2 : i + 4], "big")
            body = raw[i + 4 : i + 2 + size]
            i += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif marker in (0xC0, 0xC1):
                frame = body
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDA:
                break
            elif marker == 0xD9:
                raise ValueError("no scan")
        bits, self.height, self.width, n = struct.unpack(">BHHB", frame[:6])
        if bits != 8 or body[0] != n:
            raise ValueError("only 8-bit images of one interleaved scan")
        parts = {frame[6 + 3 * k]: (frame[7 + 3 * k] >> 4, frame[7 + 3 * k] & 15, frame[8 + 3 * k]) for k in range(n)}
        self.parts = []
        for k in range(n):
            h, v, q = parts[body[1 + 2 * k]]
            tables = body[2 + 2 * k]
            self.parts.append((h if n > 1 else 1, v if n > 1 else 1, quant[q], huff[tables >> 4], huff[0x10 | tables & 15]))
        self.hmax, self.vmax = max(p[0] for p in self.parts), max(p[1] for p in self.parts)
        self.mx, self.my = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.interval = interval or self.mx * self.my
        self.scan = i
        self.end = raw.find(b"\xff\xd9", i)
        if self.end < 0:
            raise ValueError("no end of image")

    def lanes(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unstuffed bytes of the scan, and start and MCU count of each restart interval."""
        data = np.frombuffer(raw, np.uint8)[self.scan : self.end]
        ff = data == 255
        after = np.r_[False, ff[:-1]]
        restart = after & (data >= 0xD0) & (data <= 0xD7)
        drop = restart | after & (data == 0)
        drop[:-1] |= restart[1:]
        kept = np.cumsum(~drop)
        starts = np.r_[0, kept[np.flatnonzero(restart)]]
        total = self.mx * self.my
        n = -(-total // self.interval)
        if len(starts) != n:
            raise ValueError("restart markers are missing")
        count = np.full(n, self.interval)
        count[-1] = total - self.interval * (n - 1)
        return data[~drop], starts, count


def _lookup(table: bytes) -> np.ndarray:
    """For each 16-bit window, code length * 256 + symbol; 0 where no code fits."""
    out, code, k = np.zeros(65536, np.uint16), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << 16 - length : code + 1 << 16 - length] = length << 8 | table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _decode(data: np.ndarray, start: np.ndarray, count: np.ndarray, parts: list) -> np.ndarray:
    """Dequantised luminance DC of each lane, MCU and luminance block, lanes in lock-step."""
    data = np.r_[data, np.full(16, 255, np.uint8)].astype(np.uint32)
    word = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    top, pos = len(word) - 1, start.astype(np.int64) * 8
    per = parts[0][0] * parts[0][1]
    out = np.zeros((len(start), int(count.max(initial=0)), per), np.int32)
    tables = [(_lookup(p[3]), _lookup(p[4])) for p in parts]
    last = np.zeros((len(parts), len(start)), np.int64)
    lanes = np.arange(len(start))

    def window(at):
        byte = np.minimum(at >> 3, top)
        return (word[byte] << (at & 7).astype(np.uint32)) >> np.uint32(8)  # 24 bits, 17 at least are valid

    def symbol(table, at):
        got = table[(window(at) >> np.uint32(8)) & np.uint32(65535)]
        if not got.all():
            raise ValueError("bad Huffman code")
        return (got >> 8).astype(np.int64), (got & 255).astype(np.int64)

    for m in range(out.shape[1]):
        live = lanes if m < count.min() else lanes[count > m]
        for c, (h, v, q, _, _) in enumerate(parts):
            dc, ac = tables[c]
            for block in range(h * v):
                at = pos[live]
                length, size = symbol(dc, at)
                at = at + length
                extra = (window(at) >> (24 - size).astype(np.uint32)).astype(np.int64)
                diff = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
                at = at + size
                last[c, live] += diff
                if not c:
                    out[live, m, block] = last[c, live] * q
                k, busy = np.ones(len(live), np.int64), np.arange(len(live))
                while len(busy):
                    length, rs = symbol(ac, at[busy])
                    at[busy] += length + (rs & 15)
                    k[busy] = np.where(rs == 0, 64, k[busy] + (rs >> 4) + 1)
                    busy = busy[k[busy] < 64]
                pos[live] = at
    return out


def thumbnails(streams: list[bytes]) -> list[list[np.ndarray]]:
    """For each stream of one or more images, their DC-only luminance thumbnails (uint8)."""
    out: list[list] = [[] for _ in streams]
    groups = defaultdict(list)
    for s, raw in enumerate(streams):
        at = 0
        while at < len(raw):
            image = _Image(raw, at)
            groups[tuple(image.parts)].append((s, len(out[s]), image, *image.lanes(raw)))
            out[s].append(None)
            at = image.end + 2
    for parts, members in groups.items():
        base = np.cumsum([0] + [len(m[3]) for m in members])
        got = _decode(np.concatenate([m[3] for m in members]), np.concatenate([m[4] + b for m, b in zip(members, base)]), np.concatenate([m[5] for m in members]), list(parts))
        lane = 0
        for s, k, image, _, start, count in members:
            own = got[lane : lane + len(start)]
            lane += len(start)
            h, v = parts[0][:2]
            dc = own[np.arange(own.shape[1])[None, :] < count[:, None]].reshape(image.my, image.mx, v, h)
            grid = dc.transpose(0, 2, 1, 3).reshape(image.my * v, image.mx * h)
            tall, wide = -(-image.height * v // (8 * image.vmax)), -(-image.width * h // (8 * image.hmax))
            out[s][k] = np.clip((grid[:tall, :wide] + 1028) >> 3, 0, 255).astype(np.uint8)
    return out


def _shrink(grid: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means of a rows x cols grid of cells (nearest samples where an axis is shorter)."""
    def cells(n, k):
        lo = np.arange(k) * n // k
        return lo, np.maximum(np.arange(1, k + 1) * n // k, lo + 1)

    total = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), np.int64)
    total[1:, 1:] = grid.cumsum(0, dtype=np.int64).cumsum(1)
    (a, b), (c, d) = cells(grid.shape[0], rows), cells(grid.shape[1], cols)
    area = (b - a)[:, None] * (d - c)[None, :]
    return (total[b][:, d] - total[a][:, d] - total[b][:, c] + total[a][:, c]) / area


def feature(grid: np.ndarray) -> str:
    """Pixel size, and average hash and difference hash of the thumbnail (64 bits each)."""
    mean, steps = _shrink(grid, 8, 8), _shrink(grid, 8, 9)
    ahash = np.packbits(mean > mean.mean()).tobytes().hex()
    dhash = np.packbits(steps[:, 1:] > steps[:, :-1]).tobytes().hex()
    return f"{grid.shape[1] * 8}x{grid.shape[0] * 8}:{ahash}:{dhash}"


def _write(batches):
    for batch in textops.slices(batches, 1 << 20):
        raw, at = textops.utf8(batch.column("text"))
        at = at.tolist()
        texts = [raw[a:b].tobytes() for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([store(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "text"])


def _read(batches):
    for batch in textops.slices(batches, 2 << 20):
        media = batch.column("text").to_pylist()
        rows = []
        for m, images in zip(media, thumbnails(media)):
            grid = np.concatenate(images)
            data = grid.tobytes()
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(grid), 8 * grid.shape[1], 8 * grid.shape[0]))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols], ["doc_id", "n_bytes", *names])


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the JPEG stream of every whole text."""
    return plain(docs, "doc_id", "text").mapInArrow(_write, "doc_id long, n_bytes long, text binary").withColumnRenamed("text", "media")


def features(media: DataFrame) -> DataFrame:
    """Dimensions, digests and thumbnail hashes, read back from the stored streams."""
    kinds = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    return media.withColumnRenamed("media", "text").mapInArrow(_read, f"doc_id long, n_bytes long, {kinds}")
