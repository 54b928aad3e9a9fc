"""Operator 8, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are single words, pairs of neighbours and pairs with one word between (skip-grams), and the beginnings of longer
words (``STEMS`` bytes, for inflected forms), each present or not, hashed to ``2**BITS`` places.  Training goes over a
bounded sample of labelled documents, in a fixed order, and over the features that ``least_docs`` of them have;
per-coordinate rates and the L1 term leave few weights that aren't zero, and those, of bounded number, are broadcast.

L1 pulls scores to the middle, and labels are unevenly many, so the raw score isn't a probability.  ``FOLDS`` further
models, each without a part of the sample, score that part; a logistic curve over those margins (Platt scaling) is
laid over the full model's, so that a score of 0.7 stands for about seven documents in ten.

Defined results: words are lower-cased and split at ASCII white space without marks at their ends; null texts are
empty; a text without a word scores by the bias alone; whole texts are scored, however long; repeated rows get
repeated scores; a null doc_id isn't held out; rows of labels with a null, of documents they don't match, or without
a 0 or 1 are left out of training; of documents that share a doc_id the least text is learnt from; where labels are all
alike nothing is scaled; without labels every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloforge.llm.arrow import frugal, keyed_texts, text_blocks
from haloforge.llm.decontam import plain
from haloforge.llm.bitmap import broadcast_bitmap, unpacked
from haloforge.llm.store import drop_table, materialize
from haloforge.llm.words import PLACES, hash_words, mix

BITS = 22
#: No more labelled documents than this are learnt from: those whose hashed ids come first.
SAMPLE = 20_000
#: So many first bytes of words that are longer.
STEMS = (5, 6, 7, 8)
FOLDS = 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every feature of every text, in no order and with repeats."""
    words, first, stems = hash_words([plain(t) for t in texts], stems=STEMS)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    shift = np.uint64(64 - BITS)
    out_text, out_place = [text], [mix(words) >> shift]
    for longer, stem in stems:
        out_text.append(text[longer])
        out_place.append(mix(stem + PLACES[9]) >> shift)
    for gap in (1, 2):
        if len(words) > gap:
            inside = text[gap:] == text[:-gap]
            out_text.append(text[gap:][inside])
            out_place.append((mix(words[:-gap] * PLACES[0] + words[gap:] * PLACES[gap]) >> shift)[inside])
    return np.concatenate(out_text), np.concatenate(out_place).astype(np.int64)


@frugal
def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label, doc_id) -> label, doc_id, distinct places."""
    for batch in batches:
        at = 0
        for _, texts in text_blocks([batch.select([2, 0])]):
            text, place = features(texts)
            both = np.unique((text << BITS) | place)
            cut = np.searchsorted(both >> BITS, np.arange(len(texts) + 1))
            held = [(both[a:b] & ((1 << BITS) - 1)).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            some = batch.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(held, pa.list_(pa.int32()))], ["label", "doc_id", "places"])
            at += len(texts)


@frugal
def _found_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """places -> place, n: in how many of a task's rows it is."""
    n = np.zeros(1 << BITS, dtype=np.int64)
    for batch in batches:
        n += np.bincount(np.asarray(batch.column(0).flatten()), minlength=len(n))
    place = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n[place])], ["place", "n"])


def _only(bitmap) -> Callable:
    """(label, doc_id, places) -> the same, with the bitmap's places alone."""

    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unpacked(bitmap)
        for batch in batches:
            places = batch.column(2)
            flat = np.asarray(places.flatten())
            kept = known[flat]
            ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(np.asarray(places.value_lengths(), dtype=np.int64))])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[kept]))], ["label", "doc_id", "places"])

    return run


class Ftrl:
    """FTRL-proximal (McMahan et al., 2013) with one rate for each coordinate; the last coordinate is the bias, without L1."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.root = np.zeros(size + 1), np.zeros(size + 1)  # root: of the summed squares of gradients

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.root)

    def _weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The last is the bias."""
        w = np.abs(z)
        w[:-1] -= self.l1
        np.maximum(w, 0.0, out=w)
        np.copysign(w, -z, out=w)
        w /= root * (1.0 / self.alpha) + (self.beta / self.alpha + self.l2)
        return w

    def learn(self, at: np.ndarray, label: int) -> None:
        """at: the coordinates that are 1, the bias last."""
        z, root = self.z[at], self.root[at]
        w = self._weights(z, root)
        g = 1.0 / (1.0 + math.exp(-min(max(float(w.sum()), -35.0), 35.0))) - label
        new = np.sqrt(root * root + g * g)
        root -= new
        root *= w
        root *= 1.0 / self.alpha
        z += root
        z += g
        self.z[at], self.root[at] = z, new


def _train(fold: int | None, epochs: int, least_docs: int, alpha: float, beta: float, l1: float, l2: float) -> Callable:
    """A model of all rows -> place, weight; of all rows but a fold -> place -1, and label and margin of the fold's rows."""

    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, places = [], [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            ids += batch.column(1).to_pylist()
            places += [np.asarray(v.values) for v in batch.column(2)]
            del batch
        place = mix(np.array(ids, dtype=np.int64).view(np.uint64))  # one order for all models, that no id's size has to do with
        order = np.lexsort((labels, ids, place)).tolist()
        known = [k for j, k in enumerate(order) if j % FOLDS != fold]
        found_in = np.zeros(1 << BITS, dtype=np.int32)
        for k in known:
            found_in[places[k]] += 1
        # Only places that are learnt from have a coordinate, so that all of them stay in the processor's cache.  Rows are
        # replaced one after the other, so that a batch of them goes before the next is done.
        live = np.flatnonzero(found_in >= least_docs)
        coordinate = np.full(1 << BITS, -1, dtype=np.int32)
        coordinate[live] = np.arange(len(live), dtype=np.int32)
        bias = np.array([len(live)], dtype=np.int32)
        for k, own in enumerate(places):
            at = coordinate[own]
            places[k] = np.concatenate([at[at >= 0], bias])
        del found_in, coordinate
        model = Ftrl(len(live), alpha, beta, l1, l2)
        for _ in range(epochs if known else 0):
            for k in known:
                model.learn(places[k], labels[k])
        w = model.weights()
        if fold is None:
            used = np.flatnonzero(w)
            columns = np.append(live, 1 << BITS)[used], np.full(len(used), -1), w[used]
        else:
            out = [k for j, k in enumerate(order) if j % FOLDS == fold]
            columns = np.full(len(out), -1), np.array([labels[k] for k in out]), np.array([w[places[k]].sum() for k in out])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["place", "label", "value"])

    return run


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve over margins that fits the labels best, by Newton's method; (1, 0) where only
    one label is there.  Targets are a little inside 0 and 1, as Platt (1999) has them."""
    ones = int(label.sum())
    if not 0 < ones < len(label):
        return 1.0, 0.0
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    ab = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ ab, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        ab = ab - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(ab[0]), 1e-3), float(ab[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = 10, least_docs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1) -> DataFrame:
    """labels (doc_id, toxic), held-out rows left out -> (place, weight), of those that aren't 0; place 2**BITS is the bias."""
    known = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("toxic").try_cast("long").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    some = known.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id", "label").limit(sample)
    # At most ``sample`` ids are sent to the texts, so that no other text is moved.
    texts = keyed_texts(docs).join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    ready = materialize(texts.select("text", "label", "doc_id").mapInArrow(_places, "label long, doc_id long, places array<int>"), "labelled")
    # Places that too few rows have are learnt by no model: they go before a training task holds the rows.
    often = ready.select("places").mapInArrow(_found_in, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs)
    often = broadcast_bitmap(often.select(F.shiftleft("place", 64 - BITS).alias("hash")), "hash", BITS)
    before, ready = ready, materialize(ready.mapInArrow(_only(often), "label long, doc_id long, places array<int>"), "labelled")
    drop_table(before)
    # Each model is one task over the bounded sample, read where it is written; the tasks run side by side.
    one = lambda fold: ready.coalesce(1).mapInArrow(_train(fold, epochs, least_docs, alpha, beta, l1, l2), "place long, label long, value double")
    found = one(None)
    for fold in range(FOLDS):
        found = found.union(one(fold))
    found = materialize(found, "model")
    margins = found.where("place = -1").toArrow()  # at most ``sample`` rows
    slope, shift = platt(margins["value"].to_numpy(), margins["label"].to_numpy())
    model = found.where("place >= 0").select("place", (F.col("value") * slope).alias("weight"))
    bias = found.sparkSession.createDataFrame([(1 << BITS, shift)], "place long, weight double")
    return model.union(bias).groupBy("place").agg(F.sum("weight").alias("weight"))


def _score(shared) -> Callable[[list[str]], np.ndarray]:
    """The scores of texts."""
    at, w = shared.value
    weights = np.zeros((1 << BITS) + 1)
    weights[at] = w
    used = weights != 0

    def run(texts: list[str]) -> np.ndarray:
        text, place = features(texts)
        live = used[place]
        both = np.unique((text[live] << BITS) | place[live])
        total = np.bincount(both >> BITS, weights[both & ((1 << BITS) - 1)], minlength=len(texts)) + weights[1 << BITS]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))

    return run


def _broadcast(docs: DataFrame, model: DataFrame):
    found = model.toArrow()  # at most 2**BITS + 1 rows, and by the L1 term far fewer
    return docs.sparkSession.sparkContext.broadcast((found["place"].to_numpy(), found["weight"].to_numpy()))


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    shared = _broadcast(docs, model)

    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _score(shared)
        for keys, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(score(texts))], ["doc_id", "score"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, learn_from: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more.  Rows are scored where they lie: nothing is shuffled, and of a
    row only its text goes to Python and its score comes back."""
    shared = _broadcast(docs, train(learn_from, labels))

    @F.arrow_udf("double")
    @frugal
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = _score(shared)
        for batch in batches:
            parts = (batch.slice(k, 512) for k in range(0, len(batch), 512))
            yield pa.array(np.concatenate([np.zeros(0), *(score([x or "" for x in part.to_pylist()]) for part in parts)]))

    return docs.where(scores("text") < threshold)
