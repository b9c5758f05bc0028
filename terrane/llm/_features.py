"""Hashed word and character n-gram features of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from ._text import _POWERS, SEGMENT

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that end a sentence: line feed, exclamation mark, full stop, question mark.
SENTENCE_END = np.zeros(256, dtype=bool)
SENTENCE_END[[10, 33, 46, 63]] = True
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _cut(blob: bytes, at: int, stops: np.ndarray) -> int:
    """The end of a segment from ``at``: after the last stop in reach, else after the last byte that is no letter."""
    end = at + SEGMENT
    if end >= len(blob):
        return len(blob)
    window = np.frombuffer(blob, dtype=np.uint8, count=SEGMENT, offset=at)
    for chosen in (stops, ~WORD):
        found = np.flatnonzero(chosen[window])
        if len(found):
            return at + int(found[-1]) + 1
    return end


def segments(texts: Sequence[str | None], lower: bool, stops: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(bytes, document index, start) of texts laid end to end, each between line feeds.

    A text of more than a segment comes in several, cut after a stop; a null
    text is empty.
    """
    parts: list[bytes] = []
    docs: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        text = text or ""
        blob = (text.lower() if lower else text).encode("utf-8", "surrogatepass")
        at = 0
        while True:
            end = _cut(blob, at, stops)
            if parts and size + end - at > SEGMENT:
                yield _joined(parts, docs)
                parts, docs, size = [], [], 0
            parts.append(blob[at:end])
            docs.append(i)
            size += end - at + 1
            at = end
            if at >= len(blob):
                break
    if parts:
        yield _joined(parts, docs)


def _joined(parts: list[bytes], docs: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    starts = np.ones(len(parts), dtype=np.int64)
    starts[1:] += np.cumsum([len(x) + 1 for x in parts[:-1]], dtype=np.int64)
    return b"\n" + b"\n".join(parts) + b"\n", np.asarray(docs), starts


def hashed(blob: bytes, separators: np.ndarray, orders: Sequence[int], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(position, feature) arrays: first of whole words, then of each order of character n-grams.

    Words are runs without separators. An n-gram lies within a word and the
    separator on either side, which counts as a space; its position is its
    second byte, always of the word.
    """
    raw = np.frombuffer(blob, dtype=np.uint8)
    outside = separators[raw]
    raw = np.where(outside, np.uint8(32), raw)
    up, down = _POWERS.get(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    edge = np.flatnonzero(np.diff(np.concatenate(([True], outside, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    shift = np.uint64(64 - bits)

    def feature(low: np.ndarray, high: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
        h = (total[high] - total[low]) * down[at]
        h += np.uint64(salt)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> shift).astype(np.int32)

    out = [(starts, feature(starts, ends, starts, 0))]
    gaps = np.zeros(len(raw) + 1, dtype=np.int32)
    np.cumsum(outside, out=gaps[1:])
    for n in orders:
        if len(raw) < n:
            out.append((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)))
            continue
        last = len(raw) - n + 1
        at = np.flatnonzero(gaps[n - 1 : n - 1 + last] == gaps[1 : 1 + last])
        out.append((at + 1, feature(at, at + n, at, n)))
    return out
