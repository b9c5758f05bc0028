"""Arrays dealt to numbered slots: one row for each slot of a chunk, its entries as raw bytes.

Millions of small facts so move through a shuffle as a few binary values, and
numpy works on a slot's entries at once. A slot is read from one partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def dealt(slot: np.ndarray, arrays: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(slots, bounds, arrays) with the entries of each slot side by side, in their order."""
    order = np.argsort(slot, kind="stable")
    ordered = slot[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, dtype=np.int64)
    return ordered[first], np.append(first, len(ordered)), [a[order] for a in arrays]


def column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column: row k holds the bytes of values[bounds[k]:bounds[k + 1]]; two-dimensional values have a row an entry."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim == 2 else 1)
    offsets = (bounds * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def entries(columns: Sequence[pa.Array], dtype: str) -> np.ndarray:
    """All entries of binary columns, one after the other."""
    return np.frombuffer(b"".join(x for c in columns for x in c.to_pylist()), dtype=dtype)


def by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each slot (first column) in turn; the batches come sorted by slot."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        slot = batch.column(0).to_numpy()
        cuts = np.flatnonzero(slot[1:] != slot[:-1]) + 1
        for at, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if waiting and waiting[0].column(0)[0].as_py() != slot[at]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(int(at), int(end - at)))
    if waiting:
        yield pa.Table.from_batches(waiting)
