"""Operator 4, benchmark decontamination by spaced seeds.

Fixed masks ignore some places of a run of words, so a passage with changed words still agrees under some mask.
Benchmark windows are hashed under each mask; documents' windows are too, and a bitmap of fixed size lets only those
through that may be among them.  These are joined on (mask, hash).  A hit gives a document, an item and a shift
between their words; the texts are then laid over each other at that shift, and around the hit the longest stretch
that agrees in ``share`` of its words or more is measured.  A document is contaminated by an item if the stretch is
at least ``min_words`` words long, or the whole of a shorter item.

No admitted overlap is lost for want of a mask: of the stretches of 13, 14, 15, 16 and 20 words with a quarter of the words
changed, wherever they stand, each has a window that some mask of ``MASKS`` finds whole (tests try them all), and longer
stretches hold such a one.  An item of 1 to 12 words has masks made for its length by rule until the same holds.

A window's places are kept as a list for each text, mask and hash, on both sides of the join, so that a text of a short
period makes one row there and not one for each pair of windows.

Defined results: words are lower-cased, split at ASCII white space and compared without ASCII marks at their ends;
null texts are empty and give nothing; items without a word give nothing, and of one, two or three words none may be
changed; ``drop_contaminated`` leaves documents that hold no more than such an item; ids that aren't integers are null; benchmark rows of one text are
found by all their ids; repeated rows of documents give one row, and of several texts under one doc_id the longest
stretch counts; ties between shifts go to the least; null doc_ids and other columns are left out of the result and
don't matter; empty tables give no rows.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haloforge.llm.arrow import fresh, frugal, keyed_texts, text_blocks
from haloforge.llm.bitmap import BITS, broadcast_bitmap, unpacked
from haloforge.llm.store import materialize
from haloforge.llm.words import PLACES, hash_words, mix

#: Fixed masks: 1 is compared, 0 ignored.  Six words each; chosen one after the other, each for the most changed passages that
#: those before it miss.
MASKS = ("11101011", "11001000111", "10110111", "1110001011", "1111100001", "1010001111", "11010111", "111111")
#: Items shorter than this have masks of their own.
LEAST = 13
SPREAD = 16
_MARKS = re.compile(r"[!-/:-@\[-`{-~]+")


def plain(text: str) -> str:
    """Marks become spaces: words that differ in punctuation alone agree."""
    return _MARKS.sub(" ", text)


def _places(mask: str) -> np.ndarray:
    return np.array([k for k, x in enumerate(mask) if x == "1"])


@functools.cache
def short_masks(n: int, share: float = 0.75) -> tuple[str, ...]:
    """Masks that find a whole item of n words, however few of its inner words as ``share`` allows are changed: of those with
    as many compared words as the item may keep, but no more than five, always the one next that finds most of what is left."""
    if n == 1:
        return ("1",)
    changed = n - int(np.ceil(share * n - 1e-9))
    left = {sum(1 << k for k in range(n) if k not in c) for c in itertools.combinations(range(1, n - 1), changed)}
    weight = min(n - changed, 5)
    offered = {}
    for span in range(weight, n + 1):
        for inner in itertools.combinations(range(1, span - 1), weight - 2):
            mask = 1 | 1 << (span - 1) | sum(1 << k for k in inner)
            offered["".join("01"[mask >> k & 1] for k in range(span))] = {p for p in left if any(p & mask << k == mask << k for k in range(n - span + 1))}
    out = []
    while left:
        best = max(sorted(offered), key=lambda m: len(offered[m] & left))
        out.append(best)
        left -= offered[best]
    return tuple(out)


def masks_for(lengths: Iterable[int]) -> list[tuple[int, str]]:
    """(number, mask): the fixed ones if an item is long enough for them, and those of each length of a short item."""
    lengths = set(lengths)
    short = sorted(n for n in lengths if 0 < n < LEAST)
    return [*(enumerate(MASKS) if any(n >= LEAST for n in lengths) else ()), *((100 * n + k, m) for n in short for k, m in enumerate(short_masks(n)))]


def seed_hashes(words: np.ndarray, number: int, mask: str) -> np.ndarray:
    """The hash of every window under the mask, at the window's first word."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, np.uint64(number), dtype=np.uint64)
    for j in _places(mask):
        total += words[j : j + n] * PLACES[j]
    return mix(total)


def _by_hash(columns: list[np.ndarray]) -> list[pa.Array]:
    """(text, mask, hash, at) -> the distinct first three, and a list of all places of each."""
    text, mask, found, at = columns
    order = np.lexsort((at, found, mask, text))
    text, mask, found, at = text[order], mask[order], found[order], at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (mask[1:] != mask[:-1]) | (found[1:] != found[:-1])
    begins = np.append(np.flatnonzero(new), len(at)).astype(np.int32)
    return [text[new], pa.array(mask[new].astype(np.int32)), pa.array(found[new].view(np.int64)), pa.ListArray.from_arrays(pa.array(begins), pa.array(at.astype(np.int32)))]


def _windows(texts: list[str], masks: Callable[[int], list[tuple[int, str]]], known: np.ndarray | None, shift: np.uint64) -> list[np.ndarray]:
    """(text, mask, hash, at) of the windows of each text under its masks, those alone that ``known`` has."""
    words, first = hash_words([plain(t) for t in texts])
    size = np.diff(first)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for number, mask in masks(size):
        found = seed_hashes(words, number, mask)
        at = np.arange(len(found)) if known is None else np.flatnonzero(known[found >> shift])
        text = np.searchsorted(first, at, side="right") - 1
        inside = at + len(mask) <= first[text + 1]
        if known is None:  # an item has the masks of its length
            n = size[text]
            inside &= n >= LEAST if number < 100 else n == number // 100
        at, text = at[inside], text[inside]
        for column, x in zip(out, (text, np.full(len(at), number), found[at], at - first[text]), strict=True):
            column.append(x)
    return [np.concatenate(x) if x else np.zeros(0, dtype=d) for x, d in zip(out, (np.int64, np.int64, np.uint64, np.int64), strict=True)]


def _seeds_of_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in text_blocks(batches):
        text, *rest = _by_hash(_windows(texts, masks_for, None, np.uint64(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.int64)[text]), *rest], ["item", "mask", "hash", "item_at"])


def _hits(masks: list[tuple[int, str]], bitmap, bits: int) -> Callable:
    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(bitmap)
        for batch in batches:
            at = 0
            for keys, texts in text_blocks([batch]):
                own = batch.column(2).slice(at, len(keys))
                at += len(keys)
                text, *rest = _by_hash(_windows(texts, lambda _: masks, known, np.uint64(64 - bits)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.int64)[text]), own.take(pa.array(text)), *rest], ["doc_id", "own", "mask", "hash", "at"])

    return run


def distinct_shifts(at: np.ndarray, item_at: np.ndarray) -> np.ndarray:
    """Of all pairs of places, the distinct differences, ascending: as few as the texts are long, however many the pairs."""
    if len(at) * len(item_at) <= 64:
        return np.unique(at[:, None] - item_at)
    low = int(at.min() - item_at.max())
    seen = np.zeros(int(at.max() - item_at.min()) - low + 1, dtype=bool)
    long, short = (at - low, -item_at) if len(at) > len(item_at) else (-item_at - low, at)
    for x in short:
        seen[long + x] = True
    return np.flatnonzero(seen) + low


def _shifts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(3), batch.column(4)
        found = [distinct_shifts(x.values.to_numpy().astype(np.int64), y.values.to_numpy().astype(np.int64)).astype(np.int32) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], ["doc_id", "own", "item", "shifts"])


def longest_stretch(same: np.ndarray, share: float) -> tuple[int, int]:
    """(begin, end) of the longest stretch that starts and ends with agreement and agrees in ``share`` of its places
    or more; the first of equals.  (0, 0) if there is none."""
    n = len(same)
    height = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0 - share, -share))])
    low = np.minimum.accumulate(height)  # descending: for an end, the first start that is low enough
    start = np.searchsorted(-low, -(height[1:] + 1e-9))
    length = np.where(same, np.arange(1, n + 1) - start, 0)
    best = int(np.argmax(length)) if n else 0
    if not n or length[best] <= 0:
        return 0, 0
    begin = int(start[best])
    while not same[begin]:
        begin += 1
    return begin, best + 1


def _overlaps(share: float, min_words: int) -> Callable:
    """Rows come by (doc_id, own, part), a text before the items that are laid over it, each item in a row of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item", "at", "n_words", "n_same", "item_words"]
        held, words = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r in range(batch.num_rows):
                doc_id, own, part, text, item = (batch.column(k)[r].as_py() for k in range(5))
                if item is None:
                    if held != (doc_id, own, part):  # repeated rows have equal texts
                        held, words = (doc_id, own, part), hash_words([plain(text)])[0]
                    continue
                assert held == (doc_id, own, part), "a text comes first"
                spelled = batch.column(5)[r].values.to_numpy().view(np.uint64)
                need, best = min(min_words, len(spelled)), None
                for shift in sorted(set(batch.column(6)[r].values.to_pylist())):
                    a, b = max(0, -shift), min(len(spelled), len(words) - shift)
                    if b - a < need:
                        continue
                    same = spelled[a:b] == words[a + shift : b + shift]
                    begin, end = longest_stretch(same, share)
                    if end - begin >= need and (best is None or end - begin > best[1]):
                        best = (a + shift + begin, end - begin, int(same[begin:end].sum()))
                if best:
                    for column, v in zip(out, (doc_id, item, *best, len(spelled)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

    return run


def _item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in text_blocks(batches):
        words, first = hash_words([plain(t) for t in texts])
        cut = [words[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(cut, pa.list_(pa.int64()))], ["item", "words"])


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.75, min_words: int = 13, bits: int = BITS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_same, item_words): documents that hold a passage of a benchmark item."""
    items = keyed_texts(benchmark, "item_id").where("doc_id is not null and text is not null")
    same_text = items.groupBy("text").agg(F.min("doc_id").alias("item"))
    ids = items.join(same_text, "text").select("item", F.col("doc_id").alias("item_id")).distinct()
    one_each = same_text.select("item", "text")
    seeds = materialize(one_each.mapInArrow(_seeds_of_items, "item long, mask int, hash long, item_at array<int>"), "seeds")
    numbers = [r[0] for r in seeds.select("mask").distinct().collect()]
    masks = [(k, m) for k, m in masks_for({LEAST if k < 100 else k // 100 for k in numbers}) if k in numbers]
    shared = broadcast_bitmap(seeds, "hash", bits)
    texts = keyed_texts(docs).where("doc_id is not null and text is not null").withColumn("own", F.xxhash64("text"))
    hits = texts.select("doc_id", "text", "own").mapInArrow(_hits(masks, shared, bits), "doc_id long, own long, mask int, hash long, at array<int>")
    met = hits.join(seeds, ["mask", "hash"]).select("doc_id", "own", "item", "at", "item_at").mapInArrow(_shifts, "doc_id long, own long, item long, shifts array<int>")
    # An item's place among SPREAD parts: a text that meets very many items is laid under them by as many tasks.
    part = F.pmod(F.xxhash64("item"), F.lit(SPREAD)).cast("int").alias("part")
    wanted = materialize(met.groupBy("doc_id", "own", "item").agg(F.flatten(F.collect_list("shifts")).alias("shifts")).select("*", part), "contaminated")
    words = one_each.mapInArrow(_item_words, "item long, words array<long>")
    columns = ["doc_id", "own", "part", "text", "item", "words", "shifts"]
    laid = wanted.join(words, "item").withColumn("text", F.lit(None).cast("string")).select(columns)
    below = texts.join(wanted.select("doc_id", "own", "part").distinct(), ["doc_id", "own"]).withColumns({"item": F.lit(None).cast("long"), "words": F.lit(None).cast("array<bigint>"), "shifts": F.lit(None).cast("array<int>")}).select(columns)
    rows = below.union(laid).repartition("doc_id", "own", "part").sortWithinPartitions("doc_id", "own", "part", F.col("item").asc_nulls_first())
    found = rows.mapInArrow(_overlaps(share, min_words), "doc_id long, item long, at long, n_words long, n_same long, item_words long")
    # Rows that repeat a doc_id are laid over each item in turn; the longest stretch counts.
    best = found.groupBy("doc_id", "item").agg(F.max(F.struct("n_words", "n_same", (-F.col("at")).alias("minus_at"), "item_words")).alias("b"))
    return best.join(ids, "item").select("doc_id", "item_id", (-F.col("b.minus_at")).alias("start_word"), "b.n_words", "b.n_same", "b.item_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = 4) -> DataFrame:
    """``docs`` without those that hold a passage of a benchmark item; doc_ids that are null or no integers stay.  One to three words
    are no passage: items of fewer words than ``least_words`` drop nothing."""
    name = fresh(docs, "bad")
    bad = materialize(contaminated(docs, benchmark).where(F.col("item_words") >= least_words).select(F.col("doc_id").alias(name)).distinct(), "bad")
    return docs.join(bad, bad[name] == docs["doc_id"].try_cast("long"), "left_anti")
