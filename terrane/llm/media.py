"""Baseline JPEG as a media column: payloads stored, read back and thumbnailed.

``store_payload`` writes bytes as the quantised coefficients of a grey baseline
JPEG, the format's lossless unit: a byte b is a coefficient of category 8
whose eight magnitude bits are b, 64 of them a block in zigzag order, a restart
interval for each block. ``Jpeg`` parses any baseline JPEG: its Huffman decoder
walks all restart intervals of all images with the same tables in lockstep, so
a step is a few numpy calls however many intervals there are. Thumbnails take
the DC coefficients of the luminance alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._memory import lean
from ._text import taken

#: Payloads are padded with bytes 255 to a positive multiple of this.
UNIT = 576
BLOCK = 64
#: Blocks in a row until the height reaches the format's limit; rows grow from there.
ROW_BLOCKS = 9
MOST_ROWS = 8191
#: Payload bytes that one lockstep decode holds at a time.
DECODE_BYTES = 1 << 20

_SOI, _EOI, _SOF0, _DHT, _DQT, _DRI, _SOS = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA


class JpegError(ValueError):
    pass


def pad(raw: bytes) -> bytes:
    short = -len(raw) % UNIT if raw else UNIT
    return raw + b"\xff" * short


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _grid(blocks: int) -> tuple[int, int]:
    wide = ROW_BLOCKS
    while -(-blocks // wide) > MOST_ROWS:
        wide += ROW_BLOCKS
    return wide, -(-blocks // wide)


def store_payload(payload: bytes) -> bytes:
    """A baseline JPEG whose coefficients are the payload; its length must be a positive multiple of 64."""
    if not payload or len(payload) % BLOCK:
        raise JpegError("a payload fills whole blocks")
    wide, high = _grid(len(payload) // BLOCK)
    if high > MOST_ROWS or wide > MOST_ROWS:
        raise JpegError("the payload exceeds the format's dimensions")
    data = np.frombuffer(payload + b"\xff" * (wide * high * BLOCK - len(payload)), dtype=np.uint8)
    # One zero bit (the only Huffman code in use), then the byte: 64 times 9 bits are 72 bytes a block.
    # The other code is 10: a code of ones alone is reserved.
    bits = np.zeros((len(data), 9), dtype=np.uint8)
    bits[:, 1:] = np.unpackbits(data).reshape(-1, 8)
    scan = np.packbits(bits.reshape(-1)).reshape(-1, 72)
    n = len(scan)
    # A zero byte follows each 255; each block but the last is followed by a restart marker.
    flat = scan.reshape(-1)
    full = flat == 255
    grow = full.astype(np.int64)
    grow[71::72] += 2
    grow[-1] -= 2
    at = np.arange(len(flat)) + np.cumsum(grow) - grow
    out = np.zeros(len(flat) + int(grow.sum()), dtype=np.uint8)
    out[at] = flat
    last = at[71::72][:-1] + 1 + full[71::72][:-1]
    out[last] = 255
    out[last + 1] = 0xD0 + (np.arange(n - 1) & 7)
    table = bytes([1, 1, *[0] * 14])
    head = [
        b"\xff\xd8",
        _segment(0xFE, b"payload_bytes=%d" % len(payload)),
        _segment(_DQT, b"\x00" + bytes([4]) + bytes([1]) * 63),
        _segment(_SOF0, struct.pack(">BHHB3B", 8, high * 8, wide * 8, 1, 1, 0x11, 0)),
        _segment(_DHT, b"\x00" + table + b"\x08\x00" + b"\x10" + table + b"\x08\x00"),
        _segment(_DRI, struct.pack(">H", 1)),
        _segment(_SOS, bytes([1, 1, 0x00, 0, 63, 0])),
    ]
    return b"".join(head) + out.tobytes() + b"\xff\xd9"


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length * 256 + symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, dtype=np.int32)
    code = k = 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            low = code << (16 - length)
            table[low : low + (1 << (16 - length))] = length << 8 | symbols[k]
            code += 1
            k += 1
        code <<= 1
    return table


@dataclass
class Jpeg:
    """The parsed markers of one baseline JPEG; ``components`` are (id, h, v, quantiser, dc table, ac table)."""

    width: int = 0
    height: int = 0
    restart: int = 0
    components: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    comment: bytes = b""
    intervals: list[bytes] = field(default_factory=list)

    @classmethod
    def parse(cls, data: bytes) -> Jpeg:
        if data[:2] != b"\xff\xd8":
            raise JpegError("no JPEG")
        out, at = cls(), 2
        frame: list[tuple[int, int, int, int]] = []
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise JpegError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == _EOI:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == _SOF0:
                bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise JpegError("samples have eight bits in a baseline image")
                frame = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (_DHT, 0xC8, 0xCC):
                raise JpegError("not a baseline image")
            elif marker == _DHT:
                while body:
                    n = sum(body[1:17])
                    out.tables[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
                    body = body[17 + n :]
            elif marker == _DQT:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    out.quantisers[body[0] & 15] = np.frombuffer(body, dtype=">u2" if wide == 2 else np.uint8, count=64, offset=1).astype(np.int32)
                    body = body[1 + 64 * wide :]
            elif marker == _DRI:
                out.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xFE:
                out.comment = body
            elif marker == _SOS:
                chosen = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
                if len(chosen) != len(frame):
                    raise JpegError("one interleaved scan is read")
                out.components = [(*c, *chosen[c[0]]) for c in frame]
                out._scan(data, at)
                break
        if not out.components:
            raise JpegError("no scan")
        return out

    def _scan(self, data: bytes, at: int) -> None:
        """Split the scan at its restart markers and take the stuffed zeros out."""
        raw = np.frombuffer(data, dtype=np.uint8, offset=at)
        full = np.flatnonzero(raw[:-1] == 255)
        after = raw[full + 1]
        end = full[(after != 0) & (after & 0xF8 != 0xD0) & (after != 255)]
        stop = int(end[0]) if len(end) else len(raw)
        marks = full[(after & 0xF8 == 0xD0) & (full < stop)]
        low = 0
        for mark in [*marks.tolist(), stop]:
            self.intervals.append(data[at + low : at + mark].replace(b"\xff\x00", b"\xff"))
            low = mark + 2

    @property
    def mcus(self) -> tuple[int, int]:
        across, down = (8 * max(c[k] for c in self.components) for k in (1, 2))
        return -(-self.width // across), -(-self.height // down)

    @property
    def pattern(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.components) == 1:
            return [0]
        return [k for k, c in enumerate(self.components) for _ in range(c[1] * c[2])]

    def key(self) -> tuple:
        """Images with equal keys decode together."""
        return tuple(self.pattern), tuple((c[4], c[5]) for c in self.components), tuple(sorted(self.tables.items()))


def decode(images: Sequence[Jpeg]) -> list[np.ndarray]:
    """Quantised coefficients of each image, blocks in scan order by 64 in zigzag order, DC prediction undone."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        groups.setdefault(image.key(), []).append(k)
    for members in groups.values():
        lots: list[list[int]] = [[]]
        size = 0
        for k in members:
            n = sum(map(len, images[k].intervals))
            if size and size + n > DECODE_BYTES:
                lots.append([])
                size = 0
            lots[-1].append(k)
            size += n
        for lot in lots:
            for k, blocks in zip(lot, _lockstep([images[k] for k in lot]), strict=True):
                out[k] = blocks
    return out  # type: ignore[return-value]


def _lockstep(images: Sequence[Jpeg]) -> list[np.ndarray]:
    lead = images[0]
    pattern = lead.pattern
    tables = [tuple(_lookup(*lead.tables[kind, c[4 + kind]]) for kind in (0, 1)) for c in lead.components]
    blobs, blocks, owner = [], [], []
    for image in images:
        mcus = image.mcus[0] * image.mcus[1]
        step = image.restart or mcus
        need = -(-mcus // step)
        if len(image.intervals) < need:
            raise JpegError("restart intervals are missing")
        blobs += image.intervals[:need]
        blocks += [min(step, mcus - k * step) * len(pattern) for k in range(need)]
        owner.append((need, mcus * len(pattern)))
    size = np.array(list(map(len, blobs)), dtype=np.int64)
    low = np.cumsum(size + 8) - size - 8
    raw = np.frombuffer(b"".join(x + b"\0" * 8 for x in blobs), dtype=np.uint8)
    # Every position's next 32 bits, so that a step reads a code or a magnitude with one gather.
    wide = raw.astype(np.uint64)
    ahead = (wide[:-4] << np.uint64(32)) | (wide[1:-3] << np.uint64(24)) | (wide[2:-2] << np.uint64(16)) | (wide[3:-1] << np.uint64(8)) | wide[4:]

    def peek(at: np.ndarray, n: int) -> np.ndarray:
        return ((ahead[at >> 3] >> (np.uint64(40 - n) - (at & 7).astype(np.uint64))) & np.uint64((1 << n) - 1)).astype(np.int64)

    todo = np.array(blocks, dtype=np.int64)
    first = np.cumsum(todo) - todo
    out = np.zeros((int(todo.sum()), 64), dtype=np.int16)
    bit, end = low * 8, (low + size) * 8
    predicted = np.zeros((len(todo), len(lead.components)), dtype=np.int64)
    for b in range(int(todo.max(initial=0))):
        live = np.flatnonzero(todo > b)
        component = pattern[b % len(pattern)]
        dc, ac = tables[component]
        rows = first[live] + b
        at = bit[live]
        k = np.zeros(len(live), dtype=np.int64)
        here = np.arange(len(live))
        while len(here):
            start = k[here] == 0
            now = at[here]
            ahead16 = peek(now, 16)
            code = np.where(start, dc[ahead16], ac[ahead16]) if start.any() else ac[ahead16]
            if not code.all():
                raise JpegError("no such Huffman code")
            symbol = code & 255
            now = now + (code >> 8)
            bits = np.where(start, symbol, symbol & 15)
            run = np.where(start, 0, symbol >> 4)
            value = peek(now, 16) >> (16 - bits)
            value = np.where(value < (1 << bits) >> 1, value - (1 << bits) + 1, value)
            at[here] = now + bits
            done = ~start & (bits == 0) & (run < 15)
            place = np.where(done, 64, k[here] + run)
            if ((place > 63) & ~done).any():
                raise JpegError("a block runs over")
            keep = place < 64
            out_rows = rows[here]
            if start.any():
                total = predicted[live[here], component] + value
                predicted[live[here[start]], component] = total[start]
                value = np.where(start, total, value)
            out[out_rows[keep], place[keep]] = value[keep]
            k[here] = place + 1
            here = here[k[here] < 64]
        bit[live] = at
    if (bit > end + 7).any():
        raise JpegError("the scan ends early")
    cuts = np.cumsum([n for _, n in owner])[:-1]
    return np.split(out, cuts)


def thumbnail(image: Jpeg, blocks: np.ndarray) -> np.ndarray:
    """The luminance at one pixel a block, from DC coefficients alone: height by width, 0 to 255."""
    _, h, v, quantiser, _, _ = image.components[0]
    across, down = image.mcus
    pattern = np.array(image.pattern)
    if len(image.components) == 1:
        h = v = 1
    dc = blocks[:, 0].reshape(across * down, len(pattern))[:, pattern == 0]
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    if len(image.components) > 1:
        grid = grid[: -(-image.height * v // (8 * max(c[2] for c in image.components))), : -(-image.width * h // (8 * max(c[1] for c in image.components)))]
    return np.clip(np.rint(grid * int(image.quantisers[quantiser][0]) / 8 + 128), 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each of 8 by 9 cell means is below its right neighbour's."""
    rows = np.linspace(0, pixels.shape[0], 9)
    columns = np.linspace(0, pixels.shape[1], 10)
    table = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    table[1:, 1:] = pixels.astype(np.float64).cumsum(0).cumsum(1)
    r0, c0 = np.floor(rows[:-1]).astype(int), np.floor(columns[:-1]).astype(int)
    r1, c1 = np.maximum(r0 + 1, np.ceil(rows[1:]).astype(int)), np.maximum(c0 + 1, np.ceil(columns[1:]).astype(int))
    sums = table[np.ix_(r1, c1)] - table[np.ix_(r0, c1)] - table[np.ix_(r1, c0)] + table[np.ix_(r0, c0)]
    means = sums / np.outer(r1 - r0, c1 - c0)
    return int.from_bytes(np.packbits(means[:, :-1] < means[:, 1:]).tobytes(), "big")


def read_payload(image: Jpeg, blocks: np.ndarray) -> bytes:
    """The bytes that ``store_payload`` was given."""
    if not image.comment.startswith(b"payload_bytes="):
        raise JpegError("no payload")
    values = blocks.astype(np.int32)
    # DC prediction restarts with each block, so all 64 are plain category-8 values.
    data = np.where(values < 0, values + 255, values).astype(np.uint8)
    return data.tobytes()[: int(image.comment[14:])]


def feature(image: Jpeg, blocks: np.ndarray) -> str:
    """Dimensions and thumbnail hash, as width x height : 16 hex digits."""
    return f"{image.width}x{image.height}:{difference_hash(thumbnail(image, blocks)):016x}"


def media_features(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: its whole text as a stored JPEG, read back.

    doc_id; n_bytes, the UTF-8 text's; payload_bytes, payload_sha256 and
    tail_crc32 (its last 32 bytes) of the payload read back; media_bytes and
    media_sha256 of the JPEG; feature, width x height and the thumbnail's
    difference hash; width, height. A null text is empty: one unit of bytes
    255. Equal texts give equal values, repeated rows come back repeated, a
    null doc_id stays null, an empty table gives no rows, other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches, 1):
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                raws, size = [], 0
                while at + len(raws) < len(texts) and (not raws or size < 4 * DECODE_BYTES):
                    raws.append((texts[at + len(raws)] or "").encode("utf-8", "surrogatepass"))
                    size += len(raws[-1])
                files = [store_payload(pad(x)) for x in raws]
                images = [Jpeg.parse(x) for x in files]
                rows = []
                for raw, stored, image, blocks in zip(raws, files, images, decode(images), strict=True):
                    payload = read_payload(image, blocks)
                    rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(image, blocks), image.width, image.height))
                columns = [pa.array(x) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raws)), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"])
                at += len(raws)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(work), "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width bigint, height bigint")
