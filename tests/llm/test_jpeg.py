import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from millrace.llm.jpeg import canonical, media_features, parse, segment, store_texts, thumbnails, write


def encode(coefficients, width, height, sampling, restart, rng):
    """A scalar writer: coefficients(component) gives blocks of 64 in scan order, drawn at random."""
    lengths = {s: 8 for s in [*range(12), 0xF0, *[r << 4 | z for r in range(8) for z in range(1, 9)]]}
    table = canonical(lengths)
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)
    mcus = -(-width // (8 * across)) * -(-height // (8 * down))
    bits, out, before, dcs = "", b"", [0] * len(sampling), []

    def put(symbol):
        code, n = table[2][symbol]
        return format(code, f"0{n}b")

    def value(x, size):
        return format(x if x > 0 else x + (1 << size) - 1, f"0{size}b") if size else ""

    def flush():
        raw = bits + "1" * (-len(bits) % 8)
        return b"".join(bytes([int(raw[i : i + 8], 2)]) + (b"\0" if raw[i : i + 8] == "1" * 8 else b"") for i in range(0, len(raw), 8))

    for m in range(mcus):
        if restart and m and m % restart == 0:
            out += flush() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, before = "", [0] * len(sampling)
        for c, (h, v) in enumerate(sampling):
            for _ in range(h * v):
                dc = rng.randint(-120, 120)
                dcs.append((c, dc))
                size = abs(dc - before[c]).bit_length()
                bits += put(size) + value(dc - before[c], size)
                before[c] = dc
                k = 1
                while k < 64 and rng.random() < 0.8:
                    run, x = rng.randint(0, 7), rng.choice([-5, 3, 100, -1])
                    if k + run > 63:
                        break
                    bits += put(run << 4 | abs(x).bit_length()) + value(x, abs(x).bit_length())
                    k += run + 1
                if k < 64:
                    bits += put(0)
    out += flush()
    spec = bytes(table[0]) + bytes(table[1])
    n = len(sampling)
    head = b"\xff\xd8" + segment(0xDB, b"\0" + b"\x08" * 64) + segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += segment(0xC4, b"\0" + spec + b"\x10" + spec) + (segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    return head + segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0") + out + b"\xff\xd9", dcs


@pytest.mark.parametrize(("sampling", "restart"), [([(1, 1)], 0), ([(1, 1)], 3), ([(1, 1)] * 3, 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_reads_any_baseline_scan(sampling, restart):
    rng = random.Random(7)
    raw, dcs = encode(None, 75, 43, sampling, restart, rng)
    other, _ = encode(None, 16, 9, sampling, restart, rng)
    thumb = thumbnails([raw, other])[0][0]
    assert thumb.shape == (6, 10)
    h, v = sampling[0]
    if len(sampling) == 1:
        h = v = 1
    luma, wide = [x for c, x in dcs if c == 0], -(-75 // (8 * h))
    for i, x in enumerate(luma):
        mcu, part = divmod(i, h * v)
        y, x_at = mcu // wide * v + part // h, mcu % wide * h + part % h
        if y < 6 and x_at < 10:
            assert thumb[y, x_at] == min(max(x + 128, 0), 255)


def test_round_trip():
    rng = random.Random(2)
    payloads = [b"\0" * 64, b"\xff" * 64, bytes(rng.randbytes(64 * 300)), "Ünïcode テスト ".encode() * 64, bytes([0, 255] * 640), bytes(rng.randbytes(64 * 8195))]
    stored = [write(p) for p in payloads]
    assert [b"".join(t.tobytes() for t in x) for x in thumbnails(stored)] == payloads
    assert len(parse(stored[-1])) == 2 and parse(stored[2])[0].height == 2400


def test_query_columns(sample):
    for r in media_features(store_texts(sample)).collect():
        text = next(t for d, t in cache(sample) if d == r.doc_id).encode()
        payload = text + b"\0" * (-len(text) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = write(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def cache(sample, known={}):
    if not known:
        known["rows"] = [(r.doc_id, r.text) for r in sample.collect()]
    return known["rows"]


def test_edges(edge, docs_of):
    rows = media_features(store_texts(edge)).collect()
    assert {(r.n_bytes, r.payload_bytes) for r in rows if r.doc_id in (1, 2)} == {(0, 64)}
    assert len({r.feature for r in rows if r.doc_id in (3, 4)}) == 1 and len(rows) == 8
    assert media_features(store_texts(docs_of([]))).count() == 0
    with pytest.raises(ValueError):
        parse(b"not a jpeg")
    assert np.array_equal(thumbnails([]), [])
