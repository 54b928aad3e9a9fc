"""Operator 2, MinHash near-dedup: DartMinHash signatures, banded joining, exact verification, classes.

1. One pass over the texts makes each document's digest and band hashes.  Exact copies fall together by digest; from
   then on only one row for each distinct text matters.
2. Texts that share a band's hash are a bucket.  Every bucket names ``LEADERS`` texts, and each text is compared with
   the leaders of its buckets.  That joins most of each class, however large.
3. Buckets whose other texts aren't all joined yet are settled by prefix filtering: two sets of a similarity share one of
   their rarest shingles, so only texts that do are compared, and of a bucket's pairs only those that lie in two
   classes so far.  No pair of a bucket is lost, and in neither step are all pairs of a bucket made.
4. Of each text a sketch says, for each of 1024 cells, whether an odd number of its shingles lies there.  Sketches differ
   in no more cells than the sets have shingles apart, so pairs whose sketches differ in too many are surely not similar
   and their shingles aren't sent.  The other pairs are compared: that counts the shared distinct shingles of both whole
   texts.  A leader's comparisons are dealt over as many tasks as they need.  Classes are connected components of the
   pairs at ``threshold`` or more.

With 24 bands of 5 coordinates, a pair of similarity 0.8 shares a bucket with a chance of 0.9999; similar pairs of
larger classes have many ways to meet.

Defined results: words are lower-cased and split at ASCII white space; a text of fewer words than a shingle is one
shingle; texts without a word are in a class only with exact copies (null is empty); repeated rows and ties are
copies; null doc_ids belong to classes but never name one; a class's id is its least doc_id; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloforge.llm.arrow import frugal, keyed_texts, text_blocks
from haloforge.llm.bitmap import broadcast_bitmap, maybe_in
from haloforge.llm.components import components
from haloforge.llm.dartminhash import bands, signatures
from haloforge.llm.store import drop_table, materialize
from haloforge.llm.words import hash_words, runs, shingles

LEADERS = 8
#: A leader's comparisons that meet in one group, on average.
_TOGETHER = 64
#: A sketch has 2**_CELLS bits.
_CELLS = 10


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _counted(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and how often each is found."""
    return np.unique(runs(words, size), return_counts=True)


def _sign(size: int, n_bands: int, rows: int, weighted: bool) -> Callable:
    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_blocks(batches, 1 << 20):
            words, first = hash_words(texts)
            sets = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            if weighted:
                pairs = [_counted(x, size) for x in sets]
                sets, weights = [p[0] for p in pairs], [p[1] for p in pairs]
            else:
                sets, weights = [shingles(x, size) for x in sets], None
            found = bands(signatures(sets, weights, n_bands * rows), rows)
            columns = [pa.array(keys, pa.int64()), pa.array([_digest(t) for t in texts], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([f if len(x) else [] for f, x in zip(found, sets, strict=True)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "bands"])

    return run


def _sketch(held: np.ndarray) -> np.ndarray:
    """A bit for each cell of the hashes' high bits: whether an odd number of them lies there; int64."""
    cells = np.bincount((held >> np.uint64(64 - _CELLS)).astype(np.int64), minlength=1 << _CELLS)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _shingle_rows(size: int) -> Callable:
    @frugal
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_blocks(batches):
            words, first = hash_words(texts)
            held = [shingles(words[a:b], size) for a, b in zip(first[:-1], first[1:], strict=True)]
            columns = [pa.array(keys, pa.binary()), pa.array([len(x) for x in held], pa.int64()), pa.array([_sketch(x) for x in held], pa.list_(pa.int64())), pa.array([x.tobytes() for x in held], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "n", "sketch", "held"])

    return run


def _maybe(bitmap) -> Callable:
    """(any columns, hash) -> rows whose hash may be in the bitmap, without it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, last = range(batch.num_columns)
            found = maybe_in(bitmap, batch.column(last).to_numpy())
            yield batch.select(rest).filter(pa.array(found))

    return run


def _maybe_shared(bitmap) -> Callable:
    """(digest, n, bands) -> one row for each band that may be in the bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column(2).flatten()
            found = maybe_in(bitmap, buckets.to_numpy())
            take = pa.array(np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())[found])
            yield pa.RecordBatch.from_arrays([buckets.filter(pa.array(found)), batch.column(0).take(take), batch.column(1).take(take)], ["bucket", "digest", "n"])

    return run


def _compare(threshold: float) -> Callable:
    """Rows come by (leader, part), the leader's own shingles first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b = [], []
            for k in range(0, batch.num_rows, 256):
                for leader, member, held in zip(*(batch.slice(k, 256).column(c).to_pylist() for c in ("leader", "member", "held")), strict=True):
                    held = np.frombuffer(held, dtype=np.uint64)
                    if member is None:
                        at, own = leader, held
                        continue
                    assert at == leader, "a leader's row comes first"
                    both = np.concatenate([own, held])
                    both.sort()
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    if shared >= threshold * (len(both) - shared) - 1e-9:
                        a.append(leader)
                        b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _of(held: DataFrame, digests: DataFrame) -> DataFrame:
    """digest, held: most texts that aren't among ``digests`` are left out before any shuffle; a join decides."""
    bitmap = broadcast_bitmap(digests.select(F.xxhash64("digest").alias("hash")), "hash")
    return held.select("digest", "held", F.xxhash64("digest").alias("hash")).mapInArrow(_maybe(bitmap), "digest binary, held binary")


def _likely(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """pairs (leader, member) without those that can't be similar: similar sets of ``a`` and ``b`` shingles have at most
    (a + b) (1 - threshold) / (1 + threshold) apart, and sketches differ in at most as many cells."""
    texts = held.select("digest", "n", "sketch")
    a, b = (texts.select(F.col("digest").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch")) for name in ("leader", "member"))
    cells = F.zip_with("leader_sketch", "member_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(cells, F.lit(0), lambda total, x: total + x)
    most = F.lit((1 - threshold) / (1 + threshold)) * (F.col("leader_n") + F.col("member_n")) + 1e-6
    return pairs.join(a, "leader").join(b, "member").where(apart <= most).select("leader", "member")


def _verified(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """pairs (leader, member) -> a written table (a, b) of those at the threshold or more."""
    likely = materialize(_likely(pairs, held, threshold), "likely")
    busy = likely.groupBy(F.col("leader").alias("busy")).agg(F.ceil(F.count("*") / F.lit(_TOGETHER)).alias("parts")).where("parts > 1")
    busy = materialize(busy, "busy")
    dealt = likely.join(busy, F.col("leader") == F.col("busy"), "left").withColumn("part", F.pmod(F.xxhash64("member"), F.coalesce("parts", F.lit(1))))
    members = dealt.select(F.col("member").alias("digest"), "leader", "part", "member")
    leaders = dealt.select("leader", "part").distinct().select(F.col("leader").alias("digest"), "leader", "part", F.lit(None).cast("binary").alias("member"))
    own = _of(held, likely.select(F.explode(F.array("leader", "member")).alias("digest")))
    rows = leaders.union(members).join(own, "digest").select("leader", "part", "member", "held")
    rows = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("member").asc_nulls_first())
    found = materialize(rows.mapInArrow(_compare(threshold), "a binary, b binary"), "similar")
    for old in (likely, busy):
        drop_table(old)
    return found


def _near_size(a: str, b: str, threshold: float) -> Column:
    return (F.col(a) >= F.lit(threshold) * F.col(b) - 1e-6) & (F.col(b) >= F.lit(threshold) * F.col(a) - 1e-6)


def _spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, label, n, few, held) -> one row for each shingle."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            sets = [np.frombuffer(x, dtype=np.int64) for x in part.column(4).to_pylist()]
            take = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in range(4)), pa.array(np.concatenate(sets))], ["digest", "label", "n", "few", "shingle"])


def _rest(members: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """members (bucket, digest, n, label) -> pairs (leader, member) of buckets with several labels that may be similar.

    Of a bucket, texts of the commonest label are held against those of others alone.  Sets of n shingles that are
    similar share one of their n - threshold n + 1 rarest, in one order for all.
    """
    sizes = materialize(members.select("label", "digest").distinct().groupBy("label").agg(F.count("*").alias("label_size")), "sizes")
    sized = members.join(sizes, "label")
    ends = sized.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("label_size", "label")).alias("most"))
    ends = materialize(ends.where("low <> high").select("bucket", F.col("most.label").alias("common")), "ends")
    mixed = members.join(ends, "bucket")
    texts = materialize(mixed.groupBy("digest", "label", "n").agg(F.max(F.col("label") != F.col("common")).alias("few")), "texts")
    spelled = texts.join(_of(held, texts), "digest").select("digest", "label", "n", "few", "held").mapInArrow(_spell, "digest binary, label binary, n long, few boolean, shingle long")
    spelled = materialize(spelled, "spelled")
    often = materialize(spelled.groupBy("shingle").agg(F.count("*").alias("found_in")).where("found_in > 1"), "often")
    shared = spelled.join(often, "shingle")
    by_text = Window.partitionBy("digest")
    placed = shared.withColumn("rank", F.row_number().over(by_text.orderBy("found_in", "shingle"))).withColumn("alone", F.col("n") - F.count("*").over(by_text))
    placed = placed.withColumn("at", (F.col("rank") + F.col("alone")).cast("long"))
    prefix = placed.where(F.col("at") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-6) + 1).select("shingle", "digest", "label", "n", "few", "at")
    prefix = materialize(prefix, "prefix")
    few = prefix.where("few").select("shingle", F.col("digest").alias("leader"), F.col("label").alias("leader_label"), F.col("n").alias("leader_n"), F.col("at").alias("leader_at"))
    # From their first shared shingle on, both must have enough left to share.
    enough = F.least(F.col("n") - F.col("at"), F.col("leader_n") - F.col("leader_at")) + 1 >= F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("leader_n")) - 1e-6
    other = (F.col("label") != F.col("leader_label")) & (~F.col("few") | (F.col("leader") < F.col("digest")))
    met = prefix.join(few, "shingle").where(other & enough & _near_size("n", "leader_n", threshold))
    pairs = materialize(met.select("leader", F.col("digest").alias("member")).distinct(), "pairs")
    for old in (sizes, ends, texts, spelled, often, prefix):
        drop_table(old)
    return pairs


def near_copies(docs: DataFrame, threshold: float = 0.8, size: int = 5, n_bands: int = 24, rows: int = 5, weighted: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest, class_key, class_id, class_size, n_shingles.

    ``weighted``: signatures weigh a shingle by how often the text has it, which suits corpora where repetition
    matters; the comparison that decides counts distinct shingles either way.
    """
    texts = keyed_texts(docs)
    signed = materialize(texts.mapInArrow(_sign(size, n_bands, rows, weighted), "doc_id long, digest binary, n long, bands array<long>"), "signatures")
    distinct = signed.groupBy("digest").agg(F.min(F.struct("n", "bands")).alias("s")).select("digest", "s.n", F.explode("s.bands").alias("bucket"))
    shared = materialize(distinct.groupBy("bucket").count().where("count > 1").select("bucket"), "shared")
    # Most bands are of one text alone, and a bitmap keeps them from being shuffled; the join decides.
    bitmap = broadcast_bitmap(shared, "bucket")
    maybe = signed.select("digest", "n", "bands").mapInArrow(_maybe_shared(bitmap), "bucket long, digest binary, n long").distinct()
    members = materialize(maybe.join(shared, "bucket").select("bucket", "digest", "n"), "members")
    # Digests are hashed once more, so that no text's place in the order has to do with its label.
    order = F.xxhash64("digest")
    # Of a text's copies, one row is read again: that of the least doc_id.
    chosen = materialize(members.select("digest").distinct(), "chosen")
    # Copies are counted out before they meet the chosen texts: a row a text on both sides.
    needed = signed.groupBy("digest").agg(F.min("doc_id").alias("id")).join(chosen, "digest", "left_semi")
    needed = materialize(needed.select("id", F.col("digest").alias("own")), "needed")
    # Another keeps most other rows from being shuffled with their texts; the join decides.
    bitmap = broadcast_bitmap(needed.select(F.xxhash64("own", "id").alias("hash")), "hash")
    with_digest = texts.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), "text").withColumn("hash", F.xxhash64("digest", "doc_id"))
    with_digest = with_digest.mapInArrow(_maybe(bitmap), "doc_id long, digest binary, text string")
    # Whatever row of a digest is left, its text is the same; grouped once more by what they are joined by, texts are shuffled once.
    once = with_digest.groupBy("digest").agg(F.min("text").alias("text")).join(needed.hint("merge"), F.col("digest") == F.col("own"), "left_semi")
    held = materialize(once.mapInArrow(_shingle_rows(size), "digest binary, n long, sketch array<long>, held binary"), "shingles")

    slot = F.pmod(order, F.lit(LEADERS))
    leaders = members.groupBy("bucket", slot.alias("slot")).agg(F.min(F.struct(order.alias("order"), "digest", "n")).alias("who")).select("bucket", F.col("who.digest").alias("leader"), F.col("who.n").alias("leader_n"))
    leaders = materialize(leaders, "leaders")
    met = members.join(leaders, "bucket").where((F.col("digest") != F.col("leader")) & _near_size("n", "leader_n", threshold))
    pairs = materialize(met.select("leader", F.col("digest").alias("member")).distinct(), "pairs")
    edges = _verified(pairs, held, threshold)
    first = materialize(components(edges).withColumnRenamed("node", "digest"), "labels")
    # A leader has met all of its bucket.
    left = members.join(leaders.select("bucket", F.col("leader").alias("digest")), ["bucket", "digest"], "left_anti")
    left = left.join(first, "digest", "left").select("bucket", "digest", "n", F.coalesce("label", "digest").alias("label"))
    labelled = materialize(left, "labelled")
    rest = _rest(labelled, held, threshold)
    found = _verified(rest, held, threshold)
    for old in (shared, members, chosen, needed, leaders, held, pairs, labelled, rest):
        drop_table(old)
    # Only what the second step found is joined anew.
    labels = components(first.select("digest", "label").union(found))
    each = signed.select("doc_id", "digest", F.col("n").alias("n_shingles")).join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    each = materialize(each.withColumn("label", F.coalesce("label", "digest")), "labelled")
    classes = materialize(each.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    return each.join(classes, "label").select("doc_id", "digest", F.col("label").alias("class_key"), "class_id", "class_size", "n_shingles")


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``docs`` with one document of each class left: that of the least doc_id; of several rows under that id in the class, that of the
    least digest, and of rows with equal texts, too, the first by a hash of all columns and the columns themselves.  Inside, a row of ``docs`` is one
    column, so no name clashes."""
    found = near_copies(docs, threshold, size)
    firsts = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    keepers = materialize(firsts.groupBy("class_key", "class_id").agg(F.min("digest").alias("digest")).select(F.col("class_id").alias("id"), "digest").distinct(), "keepers")
    rows = docs.select(F.struct("*").alias("doc")).select("doc", F.unhex(F.md5(F.coalesce("doc.text", F.lit("")))).alias("own"), F.col("doc.doc_id").try_cast("long").alias("key"))
    kept = rows.join(keepers, F.col("id").eqNullSafe(F.col("key")) & (F.col("digest") == F.col("own")), "left_semi")
    other = [c for c in docs.columns if c != "text"]
    tie = F.to_json(F.struct(*[F.col("doc").getField(c).alias(f"c{k}") for k, c in enumerate(other)]))
    first = kept.groupBy("key", "own").agg(F.min_by("doc", F.struct(F.xxhash64(tie), tie)).alias("doc"))
    return first.select("doc.*").select(docs.columns)
