"""Operator 12, source divergence audit: how far apart the word use of each language's sources is, and by which words.

Each source of a language, and each language, gives each kept term a share of a thousand million, ``1 + floor(10**9 * (count
+ PRIOR) / (all + PRIOR * terms))``.  The divergence of two sources is the sum of the differences over all kept terms.

*Heavy-light split.*  A term that a quarter of the language's sources or more have is heavy, and comes into dense tiles: a
matrix of sources x terms, absent terms at the source's least share, and sums of absolute differences of its rows.  For
the other terms nothing is done where both sources lack them but to count them.  With ``a0`` and ``b0`` the shares of absent
terms, two sources' light terms add up to

    sum over a's terms |a - b0|  +  sum over b's terms |b - a0|  +  (terms that neither has) * |a0 - b0|
    + sum over terms both have (|a - b| - |a - b0| - |b - a0|)

the first two by running sums over sorted shares, the last by pairing the term's postings.  All is whole numbers, and both
kinds of sums are added exactly.

A tile is a slice of a language's terms, of ``TILE_TERMS`` on average, and a pair of blocks of its sources, ``BLOCK`` each
on average, so a task holds a bounded matrix however many terms or sources there are, and a source with most rows is
spread over as many tiles as its terms.

Defined results: null texts, languages and sources are empty; a document is a row, so repeated rows count; a term of any
length is kept whole; ties of value are ranked by the item's bytes; sources without a kept term have the least share for each;
a language without kept terms has value 0 for all pairs; a language of one source has no pairs; an empty table gives no rows.
Columns besides text, lang and source aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloforge.llm.store import drop_table, materialize
from haloforge.llm.tokenspans import encoded, groups, spans

LEAST_DOCS = 30
PRIOR = 5
TOTAL = 1_000_000_000
TERM_RANKS = 50
#: A term that so large a part of its language's sources have is heavy.
HEAVY = 0.25
TILE_TERMS = 512
BLOCK = 64
#: Postings paired at once.
PAIRS_AT_ONCE = 1 << 20
_BLOCK_BYTES = 1 << 24
#: Bytes of a term: A to Z, a to z, and all of characters beyond ASCII.
TERM_BYTES = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> lang, source, term, n, docs: sums over some rows."""
    for batch in groups(batches, 2, _BLOCK_BYTES):
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        number: dict[tuple, int] = {}
        group = np.array([number.setdefault(x, len(number)) for x in names], dtype=np.int64)
        data, sizes, first = spans(batch.column(2), TERM_BYTES)
        ids, terms = encoded(data, sizes)
        doc = np.repeat(np.arange(len(names)), np.diff(first))
        width = max(len(terms), 1)
        in_doc, n = np.unique(doc * width + ids, return_counts=True)
        key = group[in_doc // width] * width + in_doc % width
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        of_group, of_term = key[cut] // width, key[cut] % width
        totals = np.add.reduceat(n, cut) if len(cut) else n
        docs = np.diff(np.append(cut, len(key)))
        langs, sources = (pa.array([k[i] for k in number], pa.string()) for i in (0, 1))
        at = pa.array(of_group)
        yield pa.RecordBatch.from_arrays(
            [langs.take(at), sources.take(at), terms.take(pa.array(of_term)).cast(pa.binary()), pa.array(totals.astype(np.int64)), pa.array(docs.astype(np.int64))],
            ["lang", "source", "term", "n", "docs"],
        )


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(TOTAL * (count + PRIOR) / (total + PRIOR * terms)); in decimals, as the product can need more than 63 bits."""
    return F.expr(f"1 + (cast({TOTAL} as decimal(10,0)) * ({count} + {PRIOR})) div cast({total} + {PRIOR} * {terms} as decimal(20,0))")


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term (bytes), n, of terms in ``least_docs`` documents of the language; with the language's n (in_lang), the
    number of its sources that have the term, and whether this is the first of them.

    Counts are summed by block, and meet by language and term, so that nothing is moved again for the language's sums.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counts = docs.select(*text).mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counts = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    sums = {"in_docs": F.sum("docs"), "in_lang": F.sum("n"), "n_sources": F.count("*"), "least": F.min("source")}
    found = counts.select("*", *[f.over(of_term).alias(c) for c, f in sums.items()]).where(F.col("in_docs") >= least_docs)
    return found.select("lang", "source", "term", "n", "in_lang", "n_sources", (F.col("source") == F.col("least")).alias("is_first"))


def sources(docs: DataFrame, posts: DataFrame, tile_terms: int = TILE_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source of all rows, with n of kept terms, the language's terms, n and sources, the share of an absent term, and
    how the tiles are cut."""
    empty = F.lit("")
    own = docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source")).distinct()
    counts = posts.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count_if("is_first").alias("first_terms"))
    rows = own.join(counts, ["lang", "source"], "left").fillna(0, ["n_all", "first_terms"])
    by_lang = rows.groupBy("lang").agg(F.sum("n_all").alias("lang_all"), F.sum("first_terms").alias("n_terms"), F.count("*").alias("lang_sources"))
    rows = rows.drop("first_terms").join(by_lang, "lang")
    blocks, slices = F.ceil(F.col("lang_sources") / block).cast("int"), F.greatest(F.ceil(F.col("n_terms") / tile_terms), F.lit(1)).cast("int")
    rows = rows.withColumns({"absent": F.when(F.col("n_terms") > 0, _share("0", "n_all", "n_terms")), "n_blocks": blocks, "n_slices": slices})
    return rows.withColumn("block", F.pmod(F.xxhash64("source"), "n_blocks").cast("int"))


def _light(src: np.ndarray, term: np.ndarray, share: np.ndarray, absent: np.ndarray, low: np.ndarray, high: np.ndarray, n_terms: int) -> np.ndarray:
    """low x high: sums over the light terms of a tile."""
    n = len(absent)
    order = np.lexsort((share, src))
    cut = np.searchsorted(src[order], np.arange(n + 1))
    apart = np.zeros((n, n), dtype=np.int64)  # sum over a's terms |a - b0|
    for a in range(n):
        v = share[order[cut[a] : cut[a + 1]]]
        before = np.concatenate([[0], np.cumsum(v)])
        k = np.searchsorted(v, absent)
        apart[a] = absent * (2 * k - len(v)) + before[-1] - 2 * before[k]
    has = np.diff(cut)
    out = apart[np.ix_(low, high)] + apart[np.ix_(high, low)].T
    out += (n_terms - has[low][:, None] - has[high][None, :]) * np.abs(absent[low][:, None] - absent[high][None, :])
    # Terms that both have: each posting of the lower block with all of the upper block's of its term.
    place = np.full(n, -1)
    place[high] = np.arange(len(high))
    right = np.flatnonzero(place[src] >= 0)
    right = right[np.argsort(term[right], kind="stable")]
    at_low = np.full(n, -1)
    at_low[low] = np.arange(len(low))
    left = np.flatnonzero(at_low[src] >= 0)
    begin, end = (np.searchsorted(term[right], term[left], side=s) for s in ("left", "right"))
    pairs = np.concatenate([[0], np.cumsum(end - begin)])
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(pairs, pairs[at] + PAIRS_AT_ONCE, side="right")) - 1)
        many = (end - begin)[at:to]
        a = np.repeat(left[at:to], many)
        b = right[np.arange(pairs[to] - pairs[at]) - np.repeat(pairs[at:to] - pairs[at] - begin[at:to], many)]
        pa_, pb, a0, b0 = share[a], share[b], absent[src[a]], absent[src[b]]
        np.add.at(out, (at_low[src[a]], place[src[b]]), np.abs(pa_ - pb) - np.abs(pa_ - b0) - np.abs(pb - a0) + np.abs(a0 - b0))
        at = to
    return out


def _heavy(src: np.ndarray, term: np.ndarray, share: np.ndarray, absent: np.ndarray, low: np.ndarray, high: np.ndarray, n_terms: int) -> np.ndarray:
    """low x high: sums over the heavy terms of a tile, as a dense matrix of sources x terms."""
    tile = np.repeat(absent[:, None], n_terms, axis=1)
    tile[src, term] = share
    upper = tile[high]
    return np.array([np.abs(upper - tile[a]).sum(axis=1) for a in low], dtype=np.int64).reshape(len(low), len(high))


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Rows of one slice of terms and two blocks of sources: a row without a term for each source, and postings.  Of the slice's
    terms, those that no source of the two blocks has are known by their number."""
    lang, first, second = (key[k].as_py() for k in (0, 1, 2))
    names = sorted(set(rows["source"].to_pylist()), key=str.encode)
    number = {x: k for k, x in enumerate(names)}
    src = np.array([number[x] for x in rows["source"].to_pylist()], dtype=np.int64)
    head = np.asarray(rows["term"].is_null())
    absent, block = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    absent[src[head]] = np.asarray(rows["absent"].fill_null(0))[head]
    block[src[head]] = np.asarray(rows["block"])[head]
    low, high = np.flatnonzero(block == first), np.flatnonzero(block == second)
    total = np.zeros((len(low), len(high)), dtype=np.int64)
    heavy, share, terms = np.asarray(rows["heavy"].fill_null(False)), np.asarray(rows["share"].fill_null(0)), rows["term"].combine_chunks()
    left = int(np.asarray(rows["slice_terms"].fill_null(0)).max())
    for which, add in ((heavy, _heavy), (~heavy & ~head, _light)):
        if which.any():
            own = terms.filter(pa.array(which)).dictionary_encode()
            n_terms = len(own.dictionary)
            total += add(src[which], np.asarray(own.indices, dtype=np.int64), share[which], absent, low, high, n_terms)
            left -= n_terms
    total += left * np.abs(absent[low][:, None] - absent[high][None, :])
    a, b = np.nonzero(np.ones_like(total) if first != second else np.triu(np.ones_like(total), 1))
    name = np.array(names, dtype=object)
    columns = [pa.array([lang] * len(a), pa.string()), pa.array(name[low[a]], pa.string()), pa.array(name[high[b]], pa.string()), pa.array(total[a, b])]
    return pa.Table.from_arrays(columns, ["lang", "a", "b", "value"])


def _pairs(posts: DataFrame, of: DataFrame, heavy: float) -> DataFrame:
    """lang, source, item, value: each two sources of a language, both ways."""
    is_heavy = F.col("n_sources") >= heavy * F.col("lang_sources")
    common = ["lang", "block", "n_blocks", "source", "absent"]
    of_term = F.pmod(F.xxhash64("term"), "n_slices").cast("int").alias("slice")
    rows = posts.select(*common, of_term, "term", "share", is_heavy.alias("heavy"), F.lit(None).cast("long").alias("slice_terms"))
    sizes = posts.where("is_first").groupBy("lang", of_term).agg(F.count("*").alias("slice_terms"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("term", "binary"), ("share", "long"), ("heavy", "boolean"))]
    heads = of.select(*common, F.explode(F.expr("sequence(0, n_slices - 1)")).alias("slice"), *none)
    rows = rows.unionByName(heads.join(sizes, ["lang", "slice"], "left"))
    rows = rows.select("*", F.explode(F.expr("sequence(0, n_blocks - 1)")).alias("other"))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "n_blocks")
    tiles = rows.groupBy("lang", "low", "high", "slice").applyInArrow(_tile, "lang string, a string, b string, value long")
    sums = materialize(tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    return sums.selectExpr("lang", "a as source", "b as item", "value").union(sums.selectExpr("lang", "b", "a", "value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS, heavy: float = HEAVY, tile_terms: int = TILE_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank.  Part ``pair``: each other source of the language, by divergence; part ``term``: the
    ``term_ranks`` terms whose share here is most above their share in the language."""
    posts = materialize(postings(docs, least_docs), "postings")
    of = materialize(sources(docs, posts, tile_terms, block), "sources")
    shares = posts.join(of, ["lang", "source"]).withColumns({"share": _share("n", "n_all", "n_terms"), "in_lang": _share("in_lang", "lang_all", "n_terms")})
    shares = materialize(shares, "shares")
    drop_table(posts)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = shares.where("share > in_lang").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("share") - F.col("in_lang")).alias("value"))
    pairs = _pairs(shares, of, heavy).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    return pairs.union(terms.select("*", rank).where(F.col("rank") <= term_ranks))
