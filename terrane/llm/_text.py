"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a run of ASCII letters, digits and non-ASCII characters of the
lower-cased text; all else separates. Hashes depend on the words alone, so
they agree between tasks, runs and table sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed in one numpy call; longer texts are cut between words.
SEGMENT = 1 << 20
SHINGLE_WORDS = 5
#: Bytes of text that a worker takes out of an Arrow batch at a time.
TAKEN = 4 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class _Powers:
    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def hash_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of each word in a lower-cased UTF-8 blob."""
    raw = np.frombuffer(blob, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _WORD_BYTE[raw]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    up, down = _POWERS.get(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts


def _segments(blob: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(blob):
        end = min(len(blob), at + SEGMENT)
        while end < len(blob) and _WORD_BYTE[blob[end]]:
            end += 1
        yield blob[at:end]
        at = end


def word_hash_run(blob: bytes) -> np.ndarray:
    """The word hashes of a lower-cased blob of any length."""
    if len(blob) <= SEGMENT:
        return hash_blob(blob)[0]
    return np.concatenate([hash_blob(x)[0] for x in _segments(blob)])


def words_and_places(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a lower-cased blob with their starts and ends."""
    inside = np.zeros(len(blob) + 2, dtype=np.int8)
    inside[1:-1] = _WORD_BYTE[np.frombuffer(blob, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    return [blob[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], starts, ends


def word_hashes(texts: Sequence[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of each text in order; a null text has no words."""
    pending: list[bytes] = []
    first = size = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        hashes, starts = hash_blob(b"\n".join(pending))
        bounds = np.cumsum([len(x) + 1 for x in pending])
        cuts = np.searchsorted(starts, bounds)
        low = 0
        for k, high in enumerate(cuts.tolist()):
            yield first + k, hashes[low:high]
            low = high

    for i, text in enumerate(texts):
        blob = (text or "").lower().encode("utf-8", "surrogatepass")
        if pending and size + len(blob) > SEGMENT:
            yield from flush()
            pending, size = [], 0
        if not pending:
            first = i
        if len(blob) > SEGMENT:
            yield i, word_hash_run(blob)
            continue
        pending.append(blob)
        size += len(blob) + 1
    if pending:
        yield from flush()


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """One hash for each window of ``size`` words; a shorter text is one shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out *= np.uint64(_MULTIPLIER)
        out += words[k : k + n]
    return mix(out)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    ordered = np.sort(values)
    first = np.empty(len(ordered), dtype=bool)
    first[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    at = np.flatnonzero(first)
    return ordered[at], np.diff(np.append(at, len(ordered)))


def taken(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about TAKEN bytes in a text column, a row at least: what bounds a worker's memory."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        total = np.cumsum(size)
        low = 0
        while low < batch.num_rows:
            before = int(total[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(total, before + TAKEN, side="right")))
            yield batch.slice(low, high - low)
            low = high


def gathered[T](parts: Iterator[T], size: Callable[[T], int], least: int) -> Iterator[list[T]]:
    """The parts in lots of ``least`` in size at least and about twice that at most, but for a task that has less: a small rest joins the lot before it."""
    lot: list[T] = []
    last = 0
    held = total = 0
    for part in parts:
        lot.append(part)
        total += size(part)
        if total - held >= least and held >= least:
            yield lot[:last]
            lot, total, held = lot[last:], total - held, 0
        if held < least <= total:
            last, held = len(lot), total
    if lot:
        yield lot
