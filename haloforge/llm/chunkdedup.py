"""Operator 10, substring dedup: content-defined chunking with a gear rolling hash.

The gear hash of a place depends on its last 16 bytes alone; where its low bits are zero a chunk ends.  Text that is
inserted or deleted so moves no later border, and a passage is cut the same way wherever it stands.  There is no
least or greatest size, as either would make borders depend on what came before.  Chunks average 32 bytes; those
whose digest is found in several documents are joined into stretches.  The parts of a passage outside its first and
last border are in chunks with its neighbours, so a stretch is shorter than its passage, and the passage is no longer than the stretch
and the two chunks beside it.  A stretch is a repeat if it has ``MIN_WORDS`` words itself and these bounds leave room for a
passage of ``PASSAGE`` words: none of that length is lost, but for the few with less than ``MIN_WORDS`` between their
borders, and shorter ones are found only where a neighbouring chunk leaves that open.  Letters are
lower-cased and runs of ASCII white space count as one space, so that a passage set in other lines is the same.

The chunks of a stretch may have their copies in different documents; that is rare but in text that repeats one word.

Documents are cut twice, for counts and for places.  The first time (digest, document) is shuffled of all chunks; the second time a bitmap of
fixed size lets those through that may be shared, and few others, so most unique chunks' places aren't shuffled.

Defined results: null and empty texts have no chunk; rows with one doc_id are one document, so repeated rows aren't
repeats of each other; a null doc_id is left out; exact copies are one long repeat each; the document of least id
holds a passage's original; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haloforge.llm.arrow import keyed_texts, text_blocks
from haloforge.llm.bitmap import BITS, broadcast_bitmap, unpacked
from haloforge.llm.store import materialize
from haloforge.llm.words import WHITE, mix, span_hashes, word_bounds

#: A pseudo-random number for each byte, made by rule.
GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(0x67656172)) >> np.uint64(48)).astype(np.uint16)


MIN_WORDS = 15
PASSAGE = 51
#: Words of a chunk and of those before and after it, in one number: low bits first.
_BESIDE, _AFTER = 40, 52
_MOST = (1 << 11) - 1


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """At each byte, the sum of (gear of the byte j places before) << j, modulo 2**16: by doubling, not byte by byte."""
    total = GEAR[buf]
    for span in (1, 2, 4, 8):
        earlier = np.zeros_like(total)
        earlier[span:] = total[:-span] << np.uint16(span)
        total = total + earlier
    return total


def chunk_ends(buf: np.ndarray, bits: int = 5) -> np.ndarray:
    """One past the last byte of each chunk.  The high bits decide: all 16 bytes weigh on them.

    Text of a short period may have no border at all.  Where none comes for eight times the average, the places whose
    hash is the least of the 64 before and the 64 after are borders, too; that depends on the text around them alone.
    """
    gear = gear_hashes(buf)
    ends = np.flatnonzero(gear >> np.uint16(16 - bits) == 0) + 1
    edges = np.concatenate([[0], ends, [len(buf)]])
    more = []
    for k in np.flatnonzero(np.diff(edges) > 8 << bits):
        part = gear[edges[k] : edges[k + 1]]
        least = np.concatenate([np.full(64, 0xFFFF, dtype=part.dtype), part, np.full(64, 0xFFFF, dtype=part.dtype)])
        for step in (1, 2, 4, 8, 16, 32, 64, 1):  # the least of 129 in a row, by doubling
            least = np.minimum(least[:-step], least[step:])
        more.append(edges[k] + 1 + np.flatnonzero(part == least[: len(part)]))
    return np.unique(np.concatenate([ends, *more])) if more else ends


def _cut(text: str, bits: int) -> tuple[np.ndarray, ...]:
    """The bytes that count, and of each chunk its end among them, first code point, length in code points, and words begun."""
    lower = text.lower()
    if len(lower) != len(text):  # letters whose small form is longer stay
        lower = "".join(small if len(small := c.lower()) == 1 else c for c in text)
    raw = np.frombuffer(lower.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return (raw, *(np.zeros(0, dtype=np.int64),) * 4)
    white = WHITE[raw]
    kept = np.flatnonzero(~(white & np.concatenate([[False], white[:-1]])))
    even = np.where(white[kept], np.uint8(32), raw[kept])
    ends = chunk_ends(even, bits)
    if not len(ends) or ends[-1] != len(even):
        ends = np.append(ends, len(even))
    starts = np.concatenate([[0], ends[:-1]])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    words = np.searchsorted(word_bounds(even)[0], ends)
    return even, ends, points[kept[starts]], points[kept[ends - 1] + 1] - points[kept[starts]], np.diff(words, prepend=0)


def chunks(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text: digest, first code point, length in code points, and words begun, of each chunk.  All are hashed together."""
    found = [_cut(t, bits) for t in texts]
    sizes = np.fromiter((len(f[0]) for f in found), dtype=np.int64, count=len(found))
    ends = [f[1] + at for f, at in zip(found, (np.cumsum(sizes) - sizes).tolist(), strict=True)]
    # A text ends with a chunk, so chunks follow each other from text to text.
    flat = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
    digests = span_hashes(np.concatenate([f[0] for f in found]), np.concatenate([[0], flat[:-1]]) if len(flat) else flat, flat).view(np.int64) if len(flat) else flat
    at = 0
    for f in found:
        yield digests[at : at + len(f[1])], *f[2:]
        at += len(f[1])


def _digests(bits: int, within: bool) -> Callable:
    """digest, doc_id and how often the document has it; at most once unless ``within``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_blocks(batches):
            if within:
                found, times = zip(*(np.unique(c[0], return_counts=True) for c in chunks(texts, bits)), strict=True)
            else:
                found = [np.unique(c[0]) for c in chunks(texts, bits)]
                times = [np.ones(len(d), dtype=np.int64) for d in found]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            columns = [pa.array(np.concatenate(found), pa.int64()), pa.array(np.repeat(np.array(keys, dtype=np.int64), sizes)), pa.array(np.concatenate(times), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "doc_id", "times"])

    return run


def _placed(bits: int, bitmap) -> Callable:
    """The chunks whose digest may be in the bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shift = unpacked(bitmap), np.uint64(64 - BITS)
        names = ["digest", "start", "length", "words"]
        for keys, texts in text_blocks(batches):
            found = list(chunks(texts, bits))
            sizes = np.fromiter((len(c[0]) for c in found), dtype=np.int64, count=len(found))
            number = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            beside = []
            for c in found:
                n = np.minimum(c[3], _MOST)
                before, after = np.concatenate([[0], n[:-1]]), np.concatenate([n[1:], [0]])
                beside.append(c[3] | before[: len(n)] << _BESIDE | after[: len(n)] << _AFTER)
            columns = [pa.array(np.concatenate([c[k] for c in found]), pa.int64() if k == 0 else pa.int32()) for k in range(3)] + [pa.array(np.concatenate(beside), pa.int64())]
            kept = pa.array(known[np.asarray(columns[0]).view(np.uint64) >> shift])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, dtype=np.int64), sizes)), pa.array(number.astype(np.int32)), *columns], ["doc_id", "number", *names]).filter(kept)

    return run


def repeated_stretches(docs: DataFrame, min_words: int = MIN_WORDS, bits: int = 5, within: bool = False, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id): stretches of code points that other documents hold too, or, with ``within``,
    that are found in any second place.  first_doc_id is the least document that holds one of the stretch's chunks."""
    texts = keyed_texts(docs).where("doc_id is not null")
    each = texts.mapInArrow(_digests(bits, within), "digest long, doc_id long, times long")
    # Rows of one doc_id are one document: without ``within``, a digest counts if two different ids have it.
    ends = [F.min("doc_id").alias("first_doc"), *([F.sum("times").alias("places")] if within else [F.max("doc_id").alias("last_doc")])]
    shared = each.groupBy("digest").agg(*ends).where("places > 1" if within else "first_doc < last_doc").select("digest", "first_doc")
    # A written table, so that adaptive execution can split a digest that very many documents have.
    shared = materialize(shared, "shared")
    placed = texts.mapInArrow(_placed(bits, broadcast_bitmap(shared, "digest")), "doc_id long, number int, digest long, start int, length int, words long")
    met = placed.join(shared, "digest").select("doc_id", "number", "start", "length", "words", "first_doc").distinct()
    island = F.col("number") - F.row_number().over(Window.partitionBy("doc_id").orderBy("number", "start", "length"))
    runs = met.withColumn("island", island).groupBy("doc_id", "island")
    own, beside = F.col("words").bitwiseAND(F.lit((1 << _BESIDE) - 1)), lambda at: F.shiftright("words", at).bitwiseAND(F.lit(_MOST))
    room = [F.min_by(beside(_BESIDE), "number").alias("before"), F.max_by(beside(_AFTER), "number").alias("after")]
    found = runs.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.sum(own).alias("n_words"), F.min("first_doc").alias("first_doc_id"), *room)
    found = found.where((F.col("n_words") >= min_words) & (F.col("n_words") + F.col("before") + F.col("after") >= passage))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_words", "first_doc_id")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, bits: int = 5, passage: int = PASSAGE) -> DataFrame:
    """``docs`` without the stretches that a document of lesser id holds; spans are cut out of ``text`` by position.  Inside, a
    row of ``docs`` is one column, so no name clashes."""
    cuts = repeated_stretches(docs, min_words, bits, passage=passage).where("first_doc_id < doc_id")
    lists = cuts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    joined = docs.select(F.struct("*").alias("doc")).join(lists, F.col("doc_id") == F.col("doc.doc_id").try_cast("long"), "left")
    zero, text = F.lit(0).cast("long"), F.col("doc.text")
    begin = F.transform(F.concat(F.array(F.struct(zero.alias("start"), zero.alias("end"))), F.col("cuts")), lambda c: c["end"])
    stop = F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.length(text).cast("long")))
    kept = F.array_join(F.zip_with(begin, stop, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), "")
    left = F.when(F.col("cuts").isNull(), text).otherwise(kept).alias("text")
    return joined.select(*[F.col("doc").getField(c).alias(c) if c != "text" else left for c in docs.columns])
