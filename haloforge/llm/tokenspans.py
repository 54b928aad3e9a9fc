"""Words of whole Arrow columns at once: bytes that belong to no word are taken out, so that no word becomes a Python object."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: What each byte becomes when A to Z are lower-cased.
FOLD = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


def groups(batches: Iterable[pa.RecordBatch], column: int, at_most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut into groups whose texts have about ``at_most`` bytes (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = _lengths(batch.column(column))
        at = 0
        ends = np.cumsum(lengths)
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, before + at_most - size, side="right"))
            if to == at and held:
                yield _one(held)
                held, size = [], 0
                continue
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= at_most:
                yield _one(held)
                held, size = [], 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(_offsets(column))


def spans(column: pa.Array, belongs: np.ndarray, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts without nulls: the bytes of all words one after the other, each word's size, and each text's first
    word (one more entry than texts).  Words are runs of bytes that ``belongs`` names; ``fold`` is what bytes become."""
    offsets = _offsets(column)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = belongs[data]
    borders = offsets[:-1][np.diff(offsets) > 0]  # first bytes of texts
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[borders] = inside[borders]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[borders[1:] - 1] = inside[borders[1:] - 1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    return fold[data[inside]], sizes, np.searchsorted(starts, offsets)


def encoded(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each word's number, and the distinct words by number, in the order they first come."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return np.asarray(words.indices, dtype=np.int64), words.dictionary
