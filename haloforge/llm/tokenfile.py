"""Operator 3, token-ID output: frequency-ranked ids in byte-aligned variable-length code.

The file format is a Parquet table, so that every store and Spark's own commit protocol serve it.  A row is a
segment of whole consecutive documents (about ``segment_tokens`` ids):

- ``part``, ``seq``: the segments' order; ``doc_ids``, ``lengths``: its documents in ascending doc_id order;
- ``ranked``: little-endian ids, the most frequent id of the segment first; an id is written as its rank here;
- ``control``: two bits an id, four ids a byte, low bits first: bytes of its rank less one;
- ``data``: the ranks' bytes, little-endian, without those that ``control`` leaves out.

Control bytes stand apart, so a reader learns from one table lookup for each of them which bytes of four ids are
there.  Frequencies are counted over all of a segment's ids: a segment is read alone, and no pass over the corpus
has to end before the first id can be written.

Defined results: a null text is empty; each row is a document; rows of one doc_id are ordered by a hash of their text and
then the text, so that a task that runs again writes the same; ids that aren't integers are cast, and those that can't be are null; a
null doc_id comes first; an empty text has the end id alone; a document longer than a segment is a segment; an
empty table gives no segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haloforge.llm.arrow import keyed_texts, text_blocks
from haloforge.llm.tokens import encoder

SCHEMA = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, ranked binary, control binary, data binary"
#: For each control byte: which of the 16 bytes of four ids are written.
_WRITTEN = np.array([[byte <= (control >> (2 * k) & 3) for k in range(4) for byte in range(4)] for control in range(256)])


def encode_ranks(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, control, data) of a segment's ids."""
    found, back, times = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((found, -times))
    place = np.empty(len(order), dtype="<u4")
    place[order] = np.arange(len(order), dtype="<u4")
    ranks = np.zeros(-(-len(ids) // 4) * 4, dtype="<u4")
    ranks[: len(ids)] = place[back]
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    control = (more.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    data = ranks.view(np.uint8)[_WRITTEN[control].ravel()]
    return found[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_ranks(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids again, as unsigned 32-bit."""
    written = _WRITTEN[np.frombuffer(control, dtype=np.uint8)].ravel()
    whole = np.zeros(len(written), dtype=np.uint8)
    whole[written] = np.frombuffer(data, dtype=np.uint8)
    return np.frombuffer(ranked, dtype="<u4")[whole.view("<u4")[:n]]


def _write_segments(path: str, end_id: int, segment_tokens: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        total = 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [part, seq, len(ids), keys, [len(x) for x in held], *encode_ranks(ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for some, texts in text_blocks(batches):
            ids, first = tokens.encode(texts)
            for key, a, b in zip(some, first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.append(ids[a:b], tokens.dtype.type(end_id))
                if held and total + len(own) > segment_tokens:
                    yield segment()
                    keys, held, total, seq = [], [], 0, seq + 1
                keys.append(key)
                held.append(own)
                total += len(own)
        if held:
            yield segment()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, segment_tokens: int = 1 << 20) -> None:
    """Write the ids of all documents to ``path`` in ascending doc_id order."""
    # The hash is a key of the ranges, too: rows that share a doc_id needn't lie in one.
    keyed = keyed_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    ordered.select("doc_id", "text").mapInArrow(_write_segments(tokenizer_path, end_id, segment_tokens), SCHEMA).write.option("compression", "zstd").parquet(path)


def _read_segments(with_ids: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, n, keys, lengths, ranked, control, data = (batch.column(k)[row].as_py() for k in range(8))
                ids = decode_ranks(ranked, control, data, n)
                ends = np.cumsum(np.array(lengths, dtype=np.int64))
                starts = ends - lengths
                cut = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array([part] * len(keys), pa.int32()), pa.array([seq] * len(keys), pa.int32()), pa.array(keys, pa.int64()),
                    pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()),
                ]
                names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype("i4") for x in cut], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, if asked)."""
    files = spark.read.schema(SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    before = files.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("before"))
    schema = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = files.mapInArrow(_read_segments(with_ids), schema)
    start = (F.col("before_part") + F.col("before") + F.col("at")).alias("start")
    return rows.join(before.join(before_part, "part"), ["part", "seq"]).select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)
