"""Operator 1, packing: bounded-space online best fit.

Each partition keeps at most ``open_windows`` windows.  A document's full windows go out at once; its rest goes to
the open window that it fills best.  Where it fits none, the fullest window goes out, topped up with the head of
the rest if ``top_up``.  The windows still open at a partition's end are merged afterwards, best fit first, in
groups of ``merge_partitions`` partitions, so no task sees more than those leave.

Defined results: a null text is empty; a null doc_id stays null; each row is a document of its own, repeated rows
too; an empty text still has the end id; a very long text is cut into full windows; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloforge.llm.arrow import frugal, keyed_texts, text_blocks
from haloforge.llm.store import materialize
from haloforge.llm.tokens import encoder

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open int"
_TYPES = {"open": pa.int32(), "ids": pa.list_(pa.int32())}


class _Windows:
    """The open windows of one partition: (room left, number) ascending, and the pieces of each."""

    def __init__(self, length: int, most: int, top_up: bool):
        self.length, self.most, self.top_up = length, most, top_up
        self.rooms: list[tuple[int, int]] = []
        self.pieces: dict[int, list[tuple]] = {}
        self.next = 0

    def _open(self) -> tuple[int, int]:
        self.next += 1
        self.pieces[self.next - 1] = []
        return self.length, self.next - 1

    def place(self, piece: tuple[int, int]) -> Iterator[tuple[int, list]]:
        """piece: (start, length), under a window long.  Yields windows that are done; (room, number) of what is placed is kept."""
        start, size = piece
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        elif len(self.rooms) < self.most:
            room, number = self._open()
        else:
            room, number = self.rooms.pop(0)
            if self.top_up:
                self.pieces[number].append((start, room))
                start, size = start + room, size - room
            yield number, self.pieces.pop(number)
            room, number = self._open()
        self.pieces[number].append((start, size))
        if room == size:
            yield number, self.pieces.pop(number)
        else:
            insort(self.rooms, (room - size, number))


def _pack_partition(path: str, end_id: int, length: int, most: int, top_up: bool, with_ids: bool) -> Callable:
    names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids

    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        high = TaskContext.get().partitionId() << 32
        windows = _Windows(length, most, top_up)
        out: list[list] = [[] for _ in names]

        def emit(number: int, pieces: list, still_open: int) -> None:
            offset = 0
            for key, start, ids, total in pieces:
                row = [key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, high | number, offset, still_open]
                for column, x in zip(out, row + [ids.astype("i4")] * with_ids, strict=True):
                    column.append(x)
                offset += len(ids)

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(x, type=_TYPES.get(name, pa.int64())) for name, x in zip(names, out, strict=True)]
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for keys, texts in text_blocks(batches):
            ids, first = tokens.encode(texts)
            for key, a, b in zip(keys, first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.append(ids[a:b], tokens.dtype.type(end_id))
                total = len(own)
                start = 0
                for start in range(0, total - total % length, length):
                    emit(windows.next, [(key, start, own[start : start + length], total)], 0)
                    windows.next += 1
                rest = total % length
                if rest:
                    for number, pieces in _placed(windows, key, own, total, total - rest, rest):
                        emit(number, pieces, 0)
            if len(out[0]) >= 20_000:
                yield batch()
        for number, pieces in windows.pieces.items():
            emit(number, pieces, 1)
        if out[0]:
            yield batch()

    return run


def _placed(windows: _Windows, key, own: np.ndarray, total: int, start: int, size: int) -> Iterator[tuple[int, list]]:
    """Place ids start.. of a document; its pieces carry the ids from then on."""

    def carry(pieces: list) -> None:
        for k, x in enumerate(pieces):
            if len(x) == 2:
                pieces[k] = (key, x[0], own[x[0] : x[0] + x[1]].copy(), total)

    for number, pieces in windows.place((start, size)):
        carry(pieces)
        yield number, pieces
    for _, number in windows.rooms:
        pieces = windows.pieces[number]
        if pieces and len(pieces[-1]) == 2:
            carry(pieces)


def _merge(length: int) -> Callable:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Best fit, longest first.  What stands in one window stays a piece of its own."""
        rows = rows.sort_values(["length", "doc_id", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        rooms: list[tuple[int, int]] = []
        sequence, offset, opened = [], [], 0
        for size in rows["length"].tolist():
            at = bisect_left(rooms, (size, -1))
            room, number = rooms.pop(at) if at < len(rooms) else (length, opened)
            opened = max(opened, number + 1)
            sequence.append((1 << 62) | (int(key[0]) << 32) | number)
            offset.append(length - room)
            if room > size:
                insort(rooms, (room - size, number))
        rows["sequence_id"], rows["offset"] = np.array(sequence, dtype="int64"), np.array(offset, dtype="int64")
        return rows.drop(columns=["group"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 2048, open_windows: int = 64, merge_partitions: int = 64, top_up: bool = True, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked).

    The pieces of a sequence_id lie gapless from offset 0; together they are at most ``length`` ids long.
    """
    schema = _PIECES + ", ids array<int>" * with_ids
    run = _pack_partition(tokenizer_path, end_id, length, open_windows, top_up, with_ids)
    pieces = materialize(keyed_texts(docs).mapInArrow(run, schema), "pieces")
    done = pieces.where("open = 0")
    left = pieces.where("open = 1").withColumn("group", F.shiftright("sequence_id", 32).cast("long") / F.lit(merge_partitions)).withColumn("group", F.floor("group").cast("long"))
    merged = left.groupBy("group").applyInPandas(_merge(length), schema)
    return done.unionByName(merged).drop("open")
