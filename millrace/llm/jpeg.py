"""Baseline JPEG media columns with DC-only thumbnails.

A JPEG's DC coefficients alone give a picture of one sample for each 8 x 8 block. ``write`` stores bytes losslessly as
such samples: each block is flat, its DC coefficient (quantised by 8) is the byte less 128, and all AC coefficients are
zero. ``thumbnails`` reads any baseline file: it parses the markers and Huffman-decodes the scan. Restart intervals
are independent, so the intervals of all pictures of a batch are decoded side by side in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field as member

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import field, map_arrow, table, text_bytes

ROW = 64  # samples in a row of the stored picture; one restart interval
ROWS = 8191  # most rows of blocks that a JPEG holds
#: Code lengths of the DC categories, short for the differences usual in text; and the only AC symbol, end of block.
DC_LENGTHS = {0: 4, 1: 5, 2: 5, 3: 4, 4: 3, 5: 2, 6: 2, 7: 3, 8: 5}
AC_LENGTHS = {0: 1}


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Counts by length, symbols in order, and symbol -> (code, length) of a JPEG Huffman table."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return counts, symbols, codes(counts, symbols)


def codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def writer_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference -255 ... 255 with the end of block after it."""
    dc = canonical(DC_LENGTHS)[2]
    bits, lengths = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        bits[d + 255] = ((code << size) | (d if d > 0 else d + (1 << size) - 1)) << 1
        lengths[d + 255] = n + size + 1
    return bits, lengths


BITS, LENGTHS = writer_tables()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def picture(samples: np.ndarray) -> bytes:
    """A grey baseline JPEG whose blocks are flat with these values (rows x ROW, uint8)."""
    rows = len(samples)
    diff = np.diff(samples.astype(np.int64) - 128, axis=1, prepend=0) + 255
    bits = np.concatenate([BITS[diff], np.zeros((rows, 1), np.uint64)], axis=1)
    lengths = np.concatenate([LENGTHS[diff], np.zeros((rows, 1), np.int64)], axis=1)
    pad = -lengths.sum(axis=1) % 8
    lengths[:, -1], bits[:, -1] = pad, (1 << pad) - 1
    ends = np.cumsum(lengths.sum(axis=1)) // 8
    bits, lengths = bits.ravel(), lengths.ravel()
    at = np.cumsum(lengths) - lengths
    word = at >> 5
    wide = np.where(lengths > 0, bits << (64 - np.maximum(lengths, 1) - (at & 31)).astype(np.uint64), np.uint64(0))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    joined = np.bitwise_or.reduceat(wide, first)
    words = np.zeros(len(joined) + 1, np.uint32)
    words[:-1] |= (joined >> np.uint64(32)).astype(np.uint32)
    words[1:] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    data = np.frombuffer(words.astype(">u4").tobytes(), np.uint8)[: ends[-1]]
    stuffed = np.flatnonzero(data == 0xFF) + 1
    marks = ends[:-1]
    data = np.insert(data, np.concatenate([stuffed, marks, marks]), np.concatenate([np.zeros(len(stuffed), np.uint8), np.full(len(marks), 0xFF, np.uint8), 0xD0 + np.arange(len(marks), dtype=np.uint8) % 8]))
    huffman = lambda kind, lengths: bytes([kind, *canonical(lengths)[0], *canonical(lengths)[1]])
    return b"".join([
        b"\xff\xd8", segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"), segment(0xDB, b"\0" + b"\x08" * 64),
        segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)), segment(0xC4, huffman(0x00, DC_LENGTHS)), segment(0xC4, huffman(0x10, AC_LENGTHS)),
        segment(0xDD, struct.pack(">H", ROW)), segment(0xDA, b"\x01\x01\0\0\x3f\0"), data.tobytes(), b"\xff\xd9",
    ])


def write(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as one JPEG, or several in a row if it has more rows than one holds."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return b"".join(picture(samples[i : i + ROWS]) for i in range(0, len(samples), ROWS))


@dataclass
class Picture:
    """What the markers of one file say, and where its scan's restart intervals lie in ``data`` (stuffing removed)."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = member(default_factory=list)  # id, h, v, quantisation table
    quantisation: dict[int, int] = member(default_factory=dict)  # DC step
    huffman: dict[int, bytes] = member(default_factory=dict)
    restart: int = 0
    tables: dict[int, tuple[int, int]] = member(default_factory=dict)  # component -> DC, AC table
    data: np.ndarray | None = None
    starts: np.ndarray | None = None


def parse(raw: bytes) -> list[Picture]:
    """Each picture of a stored form; anything but a baseline scan is refused."""
    out, at = [], 0
    while at < len(raw):
        if raw[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        p, at = Picture(), at + 2
        while True:
            marker, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            body, at = raw[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide, n = body[0] >> 4, body[0] & 15
                    p.quantisation[n] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC0:
                _, p.height, p.width, n = struct.unpack(">BHHB", body[:6])
                p.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    p.huffman[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDD:
                p.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                p.tables = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)}
                break
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError(f"not baseline: marker {marker:02X}")
        scan = np.frombuffer(raw, np.uint8)[at:]
        ff = np.flatnonzero(scan[:-1] == 0xFF)
        after = scan[ff + 1]
        end = int(ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))][0])
        ff, after = ff[ff < end], after[ff < end]
        keep = np.ones(end, bool)
        keep[ff + 1] = False
        marks = ff[after != 0]
        keep[marks] = False
        p.data = scan[:end][keep]
        kept = np.cumsum(keep)
        p.starts = np.concatenate(([0], kept[marks]))
        out.append(p)
        at += end + 2
        if raw[at - 1] != 0xD9:
            raise ValueError("no end of image after the scan")
    return out


class Lookup:
    """A Huffman table by the next 16 bits: symbol and code length."""

    def __init__(self, spec: bytes):
        self.symbol, self.length = np.zeros(1 << 16, np.int64), np.full(1 << 16, 17, np.int64)
        self.codes = codes(list(spec[:16]), list(spec[16:]))
        for s, (code, n) in self.codes.items():
            self.symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
            self.length[code << (16 - n) : (code + 1) << (16 - n)] = n


def dc_values(windows: np.ndarray, starts: np.ndarray, counts: np.ndarray, pattern: list[tuple[int, Lookup, Lookup]]) -> np.ndarray:
    """DC coefficients (stream, MCU, block of the pattern), decoded in all streams side by side.

    ``windows``: the 40 bits of the data from each byte on, so that 32 remain at any bit. ``starts``: first byte of each stream; ``counts``: its MCUs.
    ``pattern``: (component, DC table, AC table) of each block of an MCU.
    """
    order = np.argsort(-counts, kind="stable")
    at, counts = starts[order].astype(np.int64) * 8, counts[order]
    out = np.zeros((len(starts), int(counts.max(initial=0)), len(pattern)), np.int32)
    before = np.zeros((len(starts), 1 + max(c for c, _, _ in pattern)), np.int32)

    def peek(at):
        return windows[at >> 3] >> (8 - (at & 7)).astype(np.uint64) & np.uint64(0xFFFFFFFF)

    for t in range(out.shape[1]):
        live = int(np.searchsorted(-counts, -t, side="left"))
        for b, (component, dc, ac) in enumerate(pattern):
            now = at[:live]
            top = (peek(now) >> np.uint64(16)).astype(np.int64)
            if (dc.length[top] > 16).any():
                raise ValueError("bad DC code")
            size = dc.symbol[top]
            now = now + dc.length[top]
            window = peek(now)
            value = (window >> (32 - size).astype(np.uint64)).astype(np.int64)
            value = np.where(value >> np.maximum(size - 1, 0) & 1, value, value - (1 << size) + 1) * (size > 0)
            before[:live, component] += value.astype(np.int32)
            out[:live, t, b] = before[:live, component]
            now = now + size
            left, k = np.arange(live), np.ones(live, np.int64)
            while len(left):  # AC coefficients are passed over
                top = (peek(now[left]) >> np.uint64(16)).astype(np.int64)
                if (ac.length[top] > 16).any():
                    raise ValueError("bad AC code")
                symbol = ac.symbol[top]
                now[left] += ac.length[top] + (symbol & 15)
                k = k + (symbol >> 4) + 1
                more = (symbol != 0) & (k < 64)
                left, k = left[more], k[more]
            at[:live] = now
    back = np.empty_like(out)
    back[order] = out
    return back


def thumbnails(stored: list[bytes]) -> list[list[np.ndarray]]:
    """Luminance pictures of one sample a block, for each stored form and each picture in it."""
    parsed = [parse(x) for x in stored]
    alike: dict[tuple, list[tuple[int, int]]] = {}
    for i, pictures in enumerate(parsed):
        for j, p in enumerate(pictures):
            longest = p.restart or -(-p.width // 8) * -(-p.height // 8)  # streams of like length go side by side, so that one without restart markers doesn't stretch all
            alike.setdefault((tuple(sorted(p.huffman.items())), tuple(p.components), tuple(sorted(p.tables.items())), longest.bit_length()), []).append((i, j))
    out: list[list] = [[None] * len(x) for x in parsed]
    for (huffman, components, tables, _), where in alike.items():
        lookups, chosen = {k: Lookup(v) for k, v in huffman}, dict(tables)
        single = len(components) == 1
        pattern = [(n, lookups[chosen[c][0]], lookups[0x10 | chosen[c][1]]) for n, (c, h, v, _) in enumerate(components) for _ in range(1 if single else h * v)]
        across, down = (1, 1) if single else components[0][1:3]
        most = [max(c[i] for c in components) for i in (1, 2)]
        starts, counts, shapes, base = [], [], [], 0
        for i, j in where:
            p = parsed[i][j]
            wide, high = (-(-p.width // 8), -(-p.height // 8)) if single else (-(-p.width // (8 * most[0])), -(-p.height // (8 * most[1])))
            each = p.restart or wide * high
            n = -(-wide * high // each)
            if n != len(p.starts):
                raise ValueError("restart markers don't fit the picture")
            starts.append(p.starts + base)
            counts.append(np.minimum(each, wide * high - each * np.arange(n)))
            shapes.append((wide, high, each, n))
            base += len(p.data)
        data = np.concatenate([*[parsed[i][j].data for i, j in where], np.zeros(8, np.uint8)]).astype(np.uint64)
        windows = data[:-4] << np.uint64(32) | data[1:-3] << np.uint64(24) | data[2:-2] << np.uint64(16) | data[3:-1] << np.uint64(8) | data[4:]
        values = dc_values(windows, np.concatenate(starts), np.concatenate(counts), pattern)
        at = 0
        for (i, j), (wide, high, each, n) in zip(where, shapes, strict=True):
            p = parsed[i][j]
            blocks = values[at : at + n, : min(each, wide * high)].reshape(-1, len(pattern))
            at += n
            luma = blocks[: wide * high, : across * down].reshape(high, wide, down, across).transpose(0, 2, 1, 3).reshape(high * down, wide * across)
            step = p.quantisation[components[0][3]]
            out[i][j] = np.clip((luma * step + 4 >> 3) + 128, 0, 255).astype(np.uint8)[: -(-p.height // 8), : -(-p.width // 8)]
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8 x 8 parts of the picture are lighter than the whole."""
    rows, columns = ([n * i // 8 for i in range(8)] for n in thumb.shape)
    tall = np.array([thumb[a : max(b, a + 1)].mean(axis=0) for a, b in zip(rows, [*rows[1:], len(thumb)], strict=True)])
    parts = np.add.reduceat(tall, columns, axis=1) if thumb.shape[1] >= 8 else tall
    return f"{int(np.packbits((parts > parts.mean()).ravel()[:64]).tobytes().hex() or '0', 16):016x}"


def payload_of(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column: each text as JPEG. A null text is empty."""

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([write(payload_of(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select("doc_id", "text"), run, T.StructType([field(docs, "doc_id"), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def media_features(media: DataFrame) -> DataFrame:
    """Features read from the media column: payload and stored digests, dimensions and thumbnail hash."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            rows = []
            stored = batch.column(2).to_pylist()
            for raw, thumbs in zip(stored, thumbnails(stored), strict=True):
                thumb = np.concatenate(thumbs) if len(thumbs) > 1 else thumbs[0]
                payload = thumb.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{thumb.shape[1] * 8}x{thumb.shape[0] * 8}:{average_hash(thumb)}"))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    kinds = [T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    return map_arrow(media.select("doc_id", "n_bytes", "media"), run, T.StructType([field(media, "doc_id"), *[T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=True)]]))


def op8_media_jpeg(spark, sf_dir: str) -> DataFrame:
    return media_features(store_texts(table(spark, sf_dir, "documents")))
