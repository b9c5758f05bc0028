import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import media

from .helpers import clashing, empty, odd_docs, sorted_rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=1500), st.integers(0, 1400).map(lambda n: b"\xff" * n)), min_size=1, max_size=5))
def test_payloads_come_back(raws):
    images = [media.Jpeg.parse(media.store_payload(media.pad(x))) for x in raws]
    for raw, image, blocks in zip(raws, images, media.decode(images), strict=True):
        assert media.read_payload(image, blocks) == media.pad(raw)
        assert image.width % 8 == 0 and (image.width // 8) * (image.height // 8) * 64 >= len(media.pad(raw))


def bits_to_bytes(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def ordinary(blocks, restart, pattern=(0,), components=((1, 1, 1),), size=(16, 8)):
    """A JPEG by a plain bit-string encoder with canonical codes of several lengths."""
    dc_symbols, ac_symbols = [0, 1, 2, 3, 4, 5, 6, 7, 8], [0x00, 0x01, 0x02, 0x11, 0x03, 0x21, 0xF0, 0x12, 0x04, 0x31]
    dc = {s: format(k, "04b") for k, s in enumerate(dc_symbols)}
    ac_lengths = [2, 2, 3, 4, 4, 5, 6, 7, 8, 8]
    ac, code, last = {}, 0, 2
    for s, n in zip(ac_symbols, ac_lengths, strict=True):
        code <<= n - last
        ac[s], last = format(code, f"0{n}b"), n
        code += 1

    def magnitude(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    parts, bits, before = [], "", [0] * len(components)
    per = len(pattern)
    for k, block in enumerate(blocks):
        if restart and k and k % (restart * per) == 0:
            parts.append(bits_to_bytes(bits))
            bits, before = "", [0] * len(components)
        c = pattern[k % per]
        n, m = magnitude(block[0] - before[c])
        before[c] = block[0]
        bits += dc[n] + m
        run = 0
        for v in block[1 : max((i for i in range(64) if block[i]), default=0) + 1]:
            if v == 0:
                run += 1
                if run == 16:
                    bits, run = bits + ac[0xF0], 0
                continue
            n, m = magnitude(v)
            bits, run = bits + ac[run << 4 | n] + m, 0
        if not block[63]:
            bits += ac[0]
    parts.append(bits_to_bytes(bits))
    scan = b"".join(p + (b"\xff" + bytes([0xD0 + k % 8]) if k + 1 < len(parts) else b"") for k, p in enumerate(parts))
    seg = media._segment
    counts = lambda lengths: bytes(sum(x == n for x in lengths) for n in range(1, 17))
    frame = b"\x08" + size[1].to_bytes(2) + size[0].to_bytes(2) + bytes([len(components)]) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in components)
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([16] * 64)) + seg(0xC0, frame) + seg(0xC4, b"\x00" + counts([4] * 9) + bytes(dc_symbols) + b"\x10" + counts(ac_lengths) + bytes(ac_symbols)) + (seg(0xDD, restart.to_bytes(2)) if restart else b"") + seg(0xDA, bytes([len(components)]) + b"".join(bytes([i, 0]) for i, _, _ in components) + b"\0\x3f\0") + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 2])
def test_ordinary_images_decode(restart):
    r = np.random.default_rng(restart)
    blocks = []
    for _ in range(6):
        b = [0] * 64
        b[0] = int(r.integers(-90, 90))
        for at, v in ((1, 1), (3, -2), (7, 1), (9, 5), (40, 1) if r.random() < 0.5 else (41, -1)):
            b[at] = v
        b[9] = int(r.integers(2, 4)) if r.random() < 0.5 else -1
        blocks.append(b)
    # Runs beyond the code table are bridged by values, so that every symbol has a code.
    for b in blocks:
        for k in range(10, 63):
            b[k] = 0 if k % 2 else 1
    image = media.Jpeg.parse(ordinary(blocks, restart, size=(24, 16)))
    assert (image.width, image.height) == (24, 16)
    got = media.decode([image])[0]
    assert got.tolist() == blocks
    thumb = media.thumbnail(image, got)
    assert thumb.tolist() == [[min(255, max(0, round(blocks[3 * y + x][0] * 2 + 128))) for x in range(3)] for y in range(2)]


def test_colour_uses_luminance():
    blocks = [[v, *[0] * 63] for v in (10, 20, 30, 40, 5, -5)]
    image = media.Jpeg.parse(ordinary(blocks, 0, (0, 0, 0, 0, 1, 2), ((1, 2, 2), (2, 1, 1), (3, 1, 1)), (16, 16)))
    assert media.thumbnail(image, media.decode([image])[0]).tolist() == [[148, 168], [188, 208]]


def test_damage_is_an_error():
    good = media.store_payload(media.pad(b"x" * 1000))
    for bad in (b"", good[:200], good[2:], good.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(media.JpegError):
            media.decode([media.Jpeg.parse(bad)])


def test_documents(spark):
    docs = odd_docs(spark)
    rows = media.media_features(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == 11
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        stored = media.store_payload(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    same = {r.doc_id: tuple(r)[1:] for r in rows}
    assert same[1] == same[2] and same[4] == same[5] and same[1] != same[7]
    assert sorted_rows(media.media_features(clashing(docs))) == sorted_rows(media.media_features(docs))
    assert media.media_features(empty(spark)).isEmpty()
