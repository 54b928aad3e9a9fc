"""Operator 11, vector code compression: each part of a vector becomes the number of the nearest entry of an integer codebook.

Components become integers, ``floor(scale * x)``; vectors are cut into equal consecutive parts, and each place of a part has
a codebook of its own.  A round is one pass over the written integers: the codebooks, of bounded size (parts x entries x
components of a part), go to all executors, Arrow batches find all distances of a part by norm expansion with one int64
matrix product, and each task adds up counts and sums of its parts by entry, at most a row for each entry and component.
These meet in a grouped shuffle, and what is left of it, again bounded by the codebooks' size, makes the next codebooks.  All
arithmetic is exact, so neither partitions nor their order change a bit of the result.

Defined results: rows whose vector is null, or holds a null, NaN or infinity, are left out; of rows with one id the lesser
vector comes first; rows without an id are coded, and start a codebook only where fewer rows with an id are there than
entries; fewer rows than entries make so many entries; repeated rows are coded and counted as often as they come; null
labels are one label; an empty table gives no rows.  Vectors of unequal length, of a length that the parts don't divide,
or so large that a squared distance needs more than 63 bits raise a ``ValueError``: no code would be right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloforge.llm.store import drop_table, materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows of a batch whose distances are computed at once.
ROWS_AT_ONCE = 4096


def _integers(scale: int) -> Callable:
    """(id, label, vector) -> the same with integers, of rows whose vector is whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            vectors = batch.column(2)
            values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)  # a null is NaN
            sizes = np.asarray(vectors.value_lengths(), dtype=np.int64)
            bad = np.zeros(len(values) + 1, dtype=np.int64)
            np.cumsum(~np.isfinite(values), out=bad[1:])
            ends = np.cumsum(sizes)
            whole = bad[ends] == bad[ends - sizes]
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(values * scale)
            scaled = scaled[np.repeat(whole, sizes)]
            if len(scaled) and np.abs(scaled).max() >= 1 << 30:
                raise ValueError(f"components beyond {(1 << 30) // scale} don't fit")
            offsets = np.concatenate([[0], np.cumsum(sizes[whole])]).astype(np.int32)
            out = batch.filter(pa.array(whole))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled.astype(np.int32)))], ["vec_id", "label", "vector"])

    return run


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector as integers; rows without a whole vector are left out."""
    rows = vectors.select(F.col(f"`{key}`").try_cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    label_type = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(_integers(scale), f"vec_id long, label {label_type}, vector array<int>")


def _rows(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches, and their vectors as the rows of a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(at, ROWS_AT_ONCE)
            yield some, np.asarray(some.column(column).flatten(), dtype=np.int64).reshape(some.num_rows, -1)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``part`` the first of the nearest rows of ``entries``, and its squared distance; all int64."""
    far = (entries * entries).sum(axis=1) - 2 * (part @ entries.T)
    found = far.argmin(axis=1)
    return found, far[np.arange(len(part)), found] + (part * part).sum(axis=1)


def _sums(books: np.ndarray) -> Callable:
    """books: parts x entries x components.  -> part, entry, place, n, total: one row for each in which the task has any part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        n, total = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for _, matrix in _rows(batches, 0):
            for p in range(parts):
                own = matrix[:, p * width : (p + 1) * width]
                found, _ = nearest(own, books[p])
                n[p] += np.bincount(found, minlength=entries)
                np.add.at(total[p], found, own)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(p, width).astype(np.int32)),
                pa.array(np.repeat(e, width).astype(np.int32)),
                pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))),
                pa.array(np.repeat(n[p, e], width)),
                pa.array(total[p, e].ravel()),
            ],
            ["part", "entry", "place", "n", "total"],
        )

    return run


def _codes(books: np.ndarray) -> Callable:
    """(id, label, vector) -> id, label, code, error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for some, matrix in _rows(batches, 2):
            code, error = np.empty((len(matrix), parts), dtype=np.uint8), np.zeros(len(matrix), dtype=np.int64)
            for p in range(parts):
                code[:, p], far = nearest(matrix[:, p * width : (p + 1) * width], books[p])
                error += far
            text = code.tobytes().hex()
            names = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(names, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def _checked(rows: DataFrame, parts: int) -> int:
    """The components of a part; 0 where there are no vectors."""
    size = F.size("vector")
    low, high, most = rows.agg(F.min(size), F.max(size), F.max(F.greatest(F.array_max("vector"), -F.array_min("vector")))).first()
    if low is None:
        return 0
    if low != high or low % parts or not low:
        raise ValueError(f"vectors have {low} to {high} components: these aren't {parts} equal parts")
    if 4 * most * most * low >= 1 << 63:
        raise ValueError(f"squared distances of {low} components up to {most} don't fit in 63 bits")
    return low // parts


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Of the written ``integer_vectors``: parts x entries x components; None where there are no rows.

    Books start as the vectors of the least ids.  After each round an entry is the floor of its parts' mean; an entry that
    no part chose stays.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number is two hexadecimal digits: 1 to 256 entries")
    width = _checked(rows, parts)
    if not width:
        return None
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    books = np.array([r.vector for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_sums(books), "part int, entry int, place int, n long, total long")
        # In one job: an iterator over the rows would run one for each shuffle partition.
        met = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
        part, entry, place, n, total = (c.to_numpy() for c in met.columns)
        books[part, entry, place] = total // n
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray | None) -> DataFrame:
    """vec_id, label, code, error of each of ``integer_vectors``."""
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if books is None:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.select("vec_id", "label", "vector").mapInArrow(_codes(books), schema)


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector that ``code`` stands for: each component is in the middle of its entry's integer."""
    parts, _, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), dtype=np.uint8).reshape(-1, parts)
            values = (books[np.arange(parts), code].reshape(-1) + 0.5) / scale
            offsets = pa.array(np.arange(0, len(values) + 1, parts * width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error (errors of equal labels together), codebooks_sha256, of every whole vector."""
    rows = materialize(integer_vectors(vectors, key, vector, label, scale), "integers")
    books = codebooks(rows, parts, entries, rounds)
    coded = materialize(encode(rows, books), "codes")
    drop_table(rows)
    # A written table, so that a label that most rows have can be split; Spark broadcasts it where it is small.
    sums = materialize(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))
