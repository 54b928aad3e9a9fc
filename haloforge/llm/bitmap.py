"""A bitmap of fixed size for 64-bit hashes: what it hasn't is surely not among them.  It is small however many there are;
the more there are, the less it keeps out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 4 MB.
BITS = 25


def _word(column: str, bits: int) -> Column:
    return F.shiftrightunsigned(column, 64 - bits + 6)


def _bit(column: str, bits: int) -> Column:
    return F.shiftrightunsigned(column, 64 - bits).bitwiseAND(F.lit(63)).cast("int")


def bitmap_words(hashes: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(word, bits): one bit for each value of the hashes' high ``bits`` bits; at most 2**(bits - 6) rows."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(column, bits)).alias("bit")
    return hashes.select(_word(column, bits).alias("word"), bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def only_maybe_in(rows: DataFrame, words: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """The rows whose hash may be in the bitmap, without Python: its words, of bounded number, are broadcast."""
    here = (_word(column, bits) == F.col("word")) & (F.getbit("bits", _bit(column, bits)) == 1)
    return rows.join(F.broadcast(words), here, "left_semi")


def broadcast_bitmap(hashes: DataFrame, column: str, bits: int = BITS):
    """One bit for each value of the hashes' high ``bits`` bits, sent to all executors.  At most 2**(bits - 6) rows, its words,
    come to the driver, as Arrow."""
    used = bitmap_words(hashes, column, bits).toArrow()
    held = np.zeros(1 << (bits - 6), dtype="<i8")
    held[used["word"].to_numpy()] = used["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(held.tobytes())


def unpacked(shared) -> np.ndarray:
    """In a task: for each value of the high bits, whether it is there."""
    return np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8), bitorder="little").view(bool)


def maybe_in(shared, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """In a task: for each 64-bit hash, whether it may be in the bitmap, which isn't unpacked for that."""
    at = hashes.view(np.uint64) >> np.uint64(64 - bits)
    held = np.frombuffer(shared.value, dtype=np.uint8)[at >> np.uint64(3)]
    return (held >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
