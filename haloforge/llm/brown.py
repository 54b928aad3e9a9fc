"""Operator 13, LM scoring: a class-based bigram model (Brown et al., 1992) with classes by exchange clustering.

Texts are cut into blocks of whole documents, written once as each block's distinct words and its tokens as numbers of those
words.  All later passes read the written blocks, and only distinct words of blocks are shuffled, never tokens.

*Exchange.*  A word goes to the class where the likelihood of the training text's class bigrams rises most (Kneser and Ney,
1993), all other words where they are.  The ``HEADS`` most frequent words do so in ``ROUNDS`` rounds over a written table of
their neighbours with counts, one row a word; in a round a word of ``TURNS`` moves, all on the counts from before the round,
so that results don't depend on partitions.  Moves that bring nothing together, though each would alone, are halved, those of the
greatest gain staying, until the likelihood rises.  Class counts, of fixed size, go to all executors; each round's moves, ``HEADS``
at most, come back.  Every other training word makes one such exchange, from a class that holds them all, by the
classes on both sides of its occurrences, wherever they are.  The end of a text has a class of its own, and stands before each text.

*Score.*  With u = (words seen once + 1) / (N + 2), an unknown word's probability is u after any class, and a known word's
``(1 - u) * P(class | class before) * n(word) / n(class)``; transitions are smoothed towards the classes' frequencies with
the weight of ``STRENGTH`` observations.  It all adds up to 1 over the known words, the end and "unknown".

Defined results: null texts are empty and have one token, the end; a null doc_id is never held out; whole texts are read,
however long; repeated rows are learnt from and scored as often as they come; without training documents all tokens are
unknown, with base score 0; an empty table gives no rows.  Columns besides the key and the text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloforge.llm.arrow import keyed_texts
from haloforge.llm.store import drop_table, materialize
from haloforge.llm.tokenspans import encoded, groups, spans
from haloforge.llm.words import WHITE

CLASSES = 64
HEADS = 1 << 14
ROUNDS = 12
TURNS = 4
STRENGTH = 10.0
#: The byte that stands for an unknown word's class.
UNKNOWN = 255
_BLOCK_BYTES = 1 << 23
#: Words of others than heads whose classes are chosen at once.
_WORDS_AT_ONCE = 1 << 14


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _lists(values: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
    """One list of all values, or lists of these sizes."""
    cuts = np.concatenate([[0], np.cumsum([len(values)] if sizes is None else sizes)])
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def _packed(ids: np.ndarray) -> bytes:
    """Numbers of 32 bits, all lowest bytes first, then all second ones and so on, compressed."""
    return pa.compress(np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _tokens(batch: pa.RecordBatch, k: int) -> np.ndarray:
    n = int(_of(batch, "lengths", k).sum())
    planes = np.frombuffer(pa.decompress(batch.column("tokens")[k].as_buffer(), 4 * n, codec="zstd"), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held, text) -> a row a block; the end of a text is the empty word."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    for batch in groups(batches, 2, _BLOCK_BYTES):
        data, sizes, first = spans(batch.column(2), ~WHITE)
        lengths = np.diff(first) + 1
        ids, words = encoded(data, np.insert(sizes, first[1:], 0))
        # Frequent words have small numbers, so that most tokens' higher bytes are 0.
        order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        ids, words = rank[ids], words.take(pa.array(order))
        learnt = np.repeat(~np.asarray(batch.column(1)), lengths)
        n = np.bincount(ids[learnt], minlength=len(words))
        columns = [
            pa.array([number], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
            pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(1)),
            _lists(lengths.astype(np.int32)),
            pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary())),
            _lists(n.astype(np.int32)),
            pa.array([_packed(ids)], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "held", "lengths", "words", "n", "tokens"])
        number += 1


_BLOCK_SCHEMA = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, words array<binary>, n array<int>, tokens binary"


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The blocks of ``docs``: words in lower case (A to Z), tokens, and how often training documents have each word."""
    rows = keyed_texts(docs, key, text)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encode, _BLOCK_SCHEMA)


def counts(blocks: DataFrame) -> DataFrame:
    """word, n of every word of training documents."""
    each = blocks.select(F.explode(F.arrays_zip("words", "n")).alias("x")).select("x.words", "x.n").where("n > 0")
    return each.groupBy(F.col("words").alias("word")).agg(F.sum("n").alias("n"))


def _of(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return np.asarray(batch.column(name)[k].values)


def _head_ids(batch: pa.RecordBatch, k: int, heads: pa.Array) -> np.ndarray:
    """The number among the heads of each word of a block, or their number for all others."""
    return np.asarray(pc.fill_null(pc.index_in(batch.column("words")[k].values, value_set=heads), len(heads)), dtype=np.int64)


def _learnt(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Which tokens are of training documents."""
    return np.repeat(~_of(batch, "held", k), _of(batch, "lengths", k))


def _pairs(words: list[bytes]) -> Callable:
    """Blocks -> first, second, n: neighbours as head numbers; the first head is the end, and stands before each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = pa.array(words, pa.binary())
        width = len(heads) + 1
        for batch in batches:
            for k in range(batch.num_rows):
                seq = _head_ids(batch, k, heads)[_tokens(batch, k)][_learnt(batch, k)]
                found, n = np.unique(np.concatenate([[0], seq[:-1]]) * width + seq, return_counts=True) if len(seq) else (seq, seq)
                yield pa.RecordBatch.from_arrays([pa.array((found // width).astype(np.int32)), pa.array((found % width).astype(np.int32)), pa.array(n.astype(np.int64))], ["first", "second", "n"])

    return run


def _cells(kind: np.ndarray, classes: int) -> Callable:
    """Neighbours -> cell, n: class bigrams of a task; a cell is the class before * classes + the class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            after = batch.column(1)
            np.add.at(total, np.repeat(kind[np.asarray(batch.column(0))], np.diff(np.asarray(after.offsets))) * classes + kind[np.asarray(after.flatten())], np.asarray(batch.column(2).flatten()))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    return run


def _grid(cells: DataFrame, classes: int) -> np.ndarray:
    """Class bigrams as a matrix, from (cell, n): ``classes`` squared rows at most."""
    out = np.zeros(classes * classes, dtype=np.int64)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(classes, classes)


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(grid: np.ndarray) -> float:
    """What depends on the classes in the log-likelihood of the class bigram model."""
    grid = grid.astype(np.float64)
    return float(_g(grid).sum() - _g(grid.sum(axis=0)).sum() - _g(grid.sum(axis=1)).sum())


def exchange_gains(grid: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, twice: int) -> np.ndarray:
    """For each class, by how much the likelihood is above that without a word of class ``own`` when it goes there.

    after, before: the word's neighbours by class; twice: how often it follows itself, counted in both of them.
    """
    grid, after, before = grid.astype(np.float64), after.astype(np.float64), before.astype(np.float64)
    # Sizes of classes as those before and after: without the word, but with its neighbours.
    rows, columns, n_rows, n_columns = grid.sum(axis=1), grid.sum(axis=0), after.sum(), before.sum()
    rows[own] -= n_rows
    columns[own] -= n_columns
    after[own] -= twice
    before[own] -= twice
    grid[own] -= after
    grid[:, own] -= before
    grid[own, own] -= twice
    right, left = _g(grid + after) - _g(grid), _g(grid + before[:, None]) - _g(grid)
    at = np.diag(grid)
    both = _g(at + after + before + twice) - _g(at)
    return right.sum(axis=1) - np.diag(right) + left.sum(axis=0) - np.diag(left) + both - (_g(rows + n_rows) - _g(rows)) - (_g(columns + n_columns) - _g(columns))


def _moves(grid: np.ndarray, kind: np.ndarray, turn: int) -> Callable:
    """Words whose turn it is -> word, class, gain, of those that move.  Class 0, the end's, and the last, the others', are no one else's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = len(grid)
        for batch in batches:
            word, to, rise = [], [], []
            for k, w in enumerate(batch.column(0).to_pylist()):
                if w == 0 or w == len(kind) - 1 or w % TURNS != turn:
                    continue
                after, n_after, before, n_before = (np.asarray(batch.column(i)[k].values) for i in (1, 2, 3, 4))
                row = np.zeros(classes, dtype=np.int64)
                column = np.zeros(classes, dtype=np.int64)
                np.add.at(row, kind[after], n_after)
                np.add.at(column, kind[before], n_before)
                gains = exchange_gains(grid, kind[w], row, column, int(n_after[after == w].sum()))[1:-1]
                best = int(gains.argmax()) + 1
                if gains[best - 1] > gains[kind[w] - 1] + 1e-6:
                    word.append(w)
                    to.append(best)
                    rise.append(float(gains[best - 1] - gains[kind[w] - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(to, pa.int32()), pa.array(rise, pa.float64())], ["word", "to", "gain"])

    return run


def head_classes(blocks: DataFrame, words: list[bytes], classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """The class of each of ``words``, the end first, and then of all others together; and class bigrams after each round."""
    kind = np.append(1 + np.arange(-1, len(words) - 1) % (classes - 1), classes).astype(np.int64)
    kind[0] = 0
    pairs = blocks.select("held", "lengths", "words", "tokens").mapInArrow(_pairs(words), "first int, second int, n long")
    pairs = materialize(pairs.groupBy("first", "second").agg(F.sum("n").alias("n")), "neighbours")
    after = pairs.groupBy(F.col("first").alias("word")).agg(F.collect_list(F.struct("second", "n")).alias("a"))
    before = pairs.groupBy(F.col("second").alias("word")).agg(F.collect_list(F.struct("first", "n")).alias("b"))
    near = materialize(after.join(before, "word").selectExpr("word", "a.second as after", "a.n as n_after", "b.first as before", "b.n as n_before"), "contexts")
    drop_table(pairs)

    def counted(kind: np.ndarray) -> np.ndarray:
        return _grid(near.select("word", "after", "n_after").mapInArrow(_cells(kind, classes + 1), "cell long, n long"), classes + 1)

    grids = [counted(kind)]
    for k in range(rounds):
        moves = near.mapInArrow(_moves(grids[-1], kind, k % TURNS), "word int, to int, gain double").collect()
        moves.sort(key=lambda r: (-r.gain, r.word))
        while moves:
            trial = kind.copy()
            trial[[r.word for r in moves]] = [r.to for r in moves]
            grid = counted(trial)
            if likelihood(grid) > likelihood(grids[-1]):
                kind = trial
                grids.append(grid)
                break
            moves = moves[: len(moves) // 2]
    drop_table(near)
    return kind, grids


def _requests(words: list[bytes], kind: np.ndarray) -> Callable:
    """Blocks -> block, place, word, near: words that are no heads, and the classes on both sides of where training texts have
    them, all before first.  The end's class stands before each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = pa.array(words, pa.binary())
        for batch in batches:
            for k in range(batch.num_rows):
                ids, tokens = _head_ids(batch, k, heads), _tokens(batch, k)
                others = np.flatnonzero(ids == len(heads))
                seq = tokens[_learnt(batch, k)]
                c = kind[ids[seq]].astype(np.uint8)
                at = np.flatnonzero(ids[seq] == len(heads))
                at = at[np.argsort(seq[at], kind="stable")]
                n = np.bincount(seq[at], minlength=len(ids))[others]
                sides = np.stack([np.concatenate([[kind[0]], c])[at], np.append(c, kind[0])[at + 1]]).astype(np.uint8)
                # Each word's classes before, then those after, in one run of bytes.
                begin = np.cumsum(n) - n
                place = np.arange(len(at)) + np.repeat(begin, n)
                near = np.empty(2 * len(at), dtype=np.uint8)
                near[place], near[place + np.repeat(n, n)] = sides[0], sides[1]
                cuts = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(near)])
                block = pa.array(np.full(len(others), batch.column("block")[k].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([block, pa.array(others.astype(np.int32)), batch.column("words")[k].values.take(pa.array(others)), packed], ["block", "place", "word", "near"])

    return run


def _answers(grid: np.ndarray) -> Callable:
    """Requests sorted by word -> block, places, n, kinds (a byte each): a row for each block that a batch has requests of.

    The class is that of the greatest gain to first order; a word that no training text has has class UNKNOWN.
    """
    classes = len(grid) - 1
    full = np.log(grid + 1.0)
    weights = np.concatenate([full[:, 1:classes], full[1:classes].T])  # after classes before it; before classes after it
    size = np.log(grid.sum(axis=1) + 1.0)[1:classes] + np.log(grid.sum(axis=0) + 1.0)[1:classes]

    def answer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        near = rows["near"].combine_chunks()
        cuts = np.frombuffer(near.buffers()[1], dtype=np.int32)[near.offset : near.offset + len(near) + 1].astype(np.int64)
        data = np.frombuffer(near.buffers()[2] or b"", dtype=np.uint8)[cuts[0] : cuts[-1]]
        ids = np.asarray(rows["word"].combine_chunks().dictionary_encode().indices, dtype=np.int64)
        n_row = np.diff(cuts) // 2
        n = np.bincount(ids, n_row).astype(np.int64)
        found = np.full(len(n), -1, dtype=np.int64)
        side = np.arange(len(data)) - np.repeat(cuts[:-1] - cuts[0], 2 * n_row) >= np.repeat(n_row, 2 * n_row)
        feature, of = data.astype(np.int64) + side * (classes + 1), np.repeat(ids, 2 * n_row)
        for at in range(0, len(n), _WORDS_AT_ONCE):
            a, b = np.searchsorted(of, [at, at + _WORDS_AT_ONCE])
            some = n[at : at + _WORDS_AT_ONCE]
            profile = np.bincount((of[a:b] - at) * 2 * (classes + 1) + feature[a:b], minlength=len(some) * 2 * (classes + 1)).reshape(len(some), -1)
            gains = profile @ weights - some[:, None] * size
            found[at : at + _WORDS_AT_ONCE] = np.where(some > 0, gains.argmax(axis=1) + 1, -1)
        found[n == 0] = UNKNOWN
        block = np.asarray(rows["block"])
        order = np.argsort(block, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(block[order], prepend=block[order[:1]] - 1)), len(order)).astype(np.int32)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))
        kinds = np.ascontiguousarray(found[ids][order].astype(np.uint8))
        columns = [pa.array(block[order[cuts[:-1]]]), lists(np.asarray(rows["place"])[order]), lists(n[ids][order])]
        yield pa.RecordBatch.from_arrays([*columns, pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(kinds)])], ["block", "places", "n", "kinds"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(2)
            cut = int(np.asarray(pc.equal(words, words[-1])).argmax())  # where the last word begins, which may go on in the next batch
            held.append(batch.slice(0, cut))
            if cut:
                yield from answer(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from answer(pa.Table.from_batches(held))

    return run


def _texts(words: list[bytes], n_heads: np.ndarray, kind: np.ndarray, n_all: int, n_words: int) -> Callable:
    """Blocks with answers -> doc_id, held_out, n_tokens, n_known, base_score, logs (of known tokens' counts), kinds (a byte a token)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = pa.array(words, pa.binary())
        for batch in batches:
            for k in range(batch.num_rows):
                ids, tokens, lengths = _head_ids(batch, k, heads), _tokens(batch, k), _of(batch, "lengths", k)
                n, of = np.append(n_heads, 0)[ids], kind[ids]
                if batch.column("answers")[k].is_valid:
                    place, n_found, kind_found = batch.column("answers")[k].values.flatten()
                    place = np.asarray(place.flatten())
                    n[place], of[place] = np.asarray(n_found.flatten()), _bytes(kind_found)[0]
                of[n == 0] = UNKNOWN
                doc = np.repeat(np.arange(len(lengths)), lengths)
                base = np.log10((n + 0.1) / (n_all + 0.1 * (n_words + 1)))[tokens]
                logs = np.log10(np.maximum(n, 1))[tokens]
                cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                kinds = np.ascontiguousarray(of[tokens].astype(np.uint8))
                columns = [
                    batch.column("doc_ids")[k].values,
                    batch.column("held")[k].values,
                    pa.array(lengths.astype(np.int64)),
                    pa.array(np.bincount(doc, n[tokens] > 0).astype(np.int64)),
                    pa.array(np.bincount(doc, base)),
                    pa.array(np.bincount(doc, logs)),
                    pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(cuts), pa.py_buffer(kinds)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "logs", "kinds"])

    return run


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value's begin."""
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    cuts = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[cuts[0] : cuts[-1]].astype(np.int64), cuts - cuts[0]


def _before(kinds: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The class before each token: the end's before a text's first."""
    out = np.concatenate([[0], kinds[:-1]])
    out[cuts[:-1]] = 0
    return out


def _text_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of training texts -> cell, n."""
    total = np.zeros((UNKNOWN + 1) ** 2, dtype=np.int64)
    for batch in batches:
        kinds, cuts = _bytes(batch.column(0))
        if len(kinds):
            total += np.bincount(_before(kinds, cuts) * (UNKNOWN + 1) + kinds, minlength=len(total))
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])


def transitions(grid: np.ndarray, once: int, strength: float = STRENGTH) -> np.ndarray:
    """log10 of what a token of a class adds after one of another, but for its word's count; row and column UNKNOWN are unknown words'."""
    n = grid.sum(axis=0).astype(np.float64)
    n_all = max(n.sum(), 1.0)
    unknown = (once + 1) / (n.sum() + 2)
    smooth = (grid + strength * n / n_all) / (grid.sum(axis=1)[:, None] + strength)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log10((1 - unknown) * smooth / n)
    out[:, UNKNOWN] = np.log10(unknown)
    return out


def _scores(table: np.ndarray) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, cuts = _bytes(batch.column("kinds"))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            own = np.bincount(doc, table[_before(kinds, cuts), kinds], minlength=batch.num_rows) + np.asarray(batch.column("logs"))
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(own)], [*names, "score"])

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: int = CLASSES, heads: int = HEADS, rounds: int = ROUNDS, strength: float = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10), perplexity of every row."""
    if not 2 <= classes < UNKNOWN:
        raise ValueError(f"a class is a byte: 2 to {UNKNOWN - 1} classes")
    blocks = materialize(encode(docs, key, text), "blocks")
    vocabulary = materialize(counts(blocks), "vocabulary")
    n_all, n_words, once = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    # At most ``heads`` words; the end is the first of them, wherever it stands by its count.  Words by the power of two of their count
    # tell how far down the heads can be, so that tasks send few others.
    powers = sorted(vocabulary.groupBy(F.floor(F.log2("n")).alias("power")).count().collect(), key=lambda r: -r.power)
    enough = [r.power for k, r in enumerate(powers) if sum(x["count"] for x in powers[: k + 1]) >= heads]
    often = vocabulary.where(F.col("n") >= (1 << enough[0])) if enough else vocabulary
    top = [(bytes(r.word), r.n) for r in often.orderBy(F.desc("n"), "word").limit(heads).collect()]
    ends = vocabulary.where(F.col("word") == F.lit(b"")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    top = [(b"", ends), *[x for x in top if x[0]]]
    words, n_heads = [w for w, _ in top], np.array([n for _, n in top], dtype=np.int64)
    drop_table(vocabulary)
    kind, grids = head_classes(blocks, words, classes, rounds)
    asked = blocks.select("block", "held", "lengths", "words", "tokens").mapInArrow(_requests(words, kind), "block long, place int, word binary, near binary")
    told = asked.repartition("word").sortWithinPartitions("word").mapInArrow(_answers(grids[-1]), "block long, places array<int>, n array<long>, kinds binary")
    told = told.groupBy(F.col("block").alias("of_block")).agg(F.collect_list(F.struct("places", "n", "kinds")).alias("answers"))
    with_answers = blocks.join(told, F.col("block") == F.col("of_block"), "left").select("doc_ids", "held", "lengths", "words", "tokens", "answers")
    texts = with_answers.mapInArrow(_texts(words, n_heads, kind, n_all, n_words), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, logs double, kinds binary")
    texts = materialize(texts, "classes")
    drop_table(blocks)
    grid = _grid(texts.where("not held_out").select("kinds").mapInArrow(_text_cells, "cell long, n long"), UNKNOWN + 1)
    found = texts.mapInArrow(_scores(transitions(grid, once, strength)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
