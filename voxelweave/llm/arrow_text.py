"""Byte-level text helpers for Arrow batches: slices of bounded size, words, units.

All of them work on the UTF-8 buffer of a string array with numpy, so the cost per word is a
few nanoseconds, and repeated words meet in a dictionary before anything slower sees them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 6 << 20


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``most`` bytes of text, one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        _, offsets = text_buffer(batch.column(at))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def lowered(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


class Words:
    """Words of a batch: a string array, and where each document's words begin."""

    def __init__(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray):
        """body: the bytes of the words, one after another; the rest: places in the whole text."""
        lengths = ends - starts
        at = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=at[1:])
        self.array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))])
        self.docs = np.searchsorted(starts, offsets)
        self.starts, self.lengths = starts, lengths

    def __len__(self) -> int:
        return len(self.lengths)

    def parents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), np.diff(self.docs))

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """Ids of the words, and the distinct words that they stand for."""
        if not len(self):
            return np.zeros(0, np.int32), pa.array([], pa.large_binary())
        both = self.array.dictionary_encode()
        return both.indices.to_numpy(), both.dictionary


def runs_of(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes marked in ``inside``, none of them across two texts."""
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    if len(data):
        after[first[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data[inside], starts, ends, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes other than the six ASCII white-space characters."""
    return runs_of(data, ~IS_SPACE[data], offsets)


def units_of(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray | None = None) -> Words:
    """A text cut before every ASCII white-space run that follows something else.

    The units of a text join to the text; each is white space, then a word.  Documents
    marked in ``whole`` stay uncut.
    """
    space = IS_SPACE[data]
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = space[1:] & ~space[:-1]
    if whole is not None and whole.any():
        cut &= ~np.repeat(whole, np.diff(offsets))
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return Words(data, starts, ends, offsets)


def code_points(data: np.ndarray) -> np.ndarray:
    """True where a byte begins a character."""
    return (data & 0xC0) != 0x80


def sums_by(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive offsets."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
