"""Operator 7, line dedup, with DataFrame functions only.

Lines are exploded, normalised and hashed; lines whose hash is found in ``min_docs`` documents or more go; the rest
is put together again by position.  ``lower`` changes letters beyond A-Z too, so it only finds candidates: equal
keys have equal lower-cased lines.  The exact key is then made and counted for those lines alone.

Defined results: a null or empty text is one empty line; a document is a distinct (doc_id, text), so repeated rows
count once and get the same result; a null doc_id is a value like others; other columns, whatever their names, pass
unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haloforge.llm.bitmap import bitmap_words, only_maybe_in
from haloforge.llm.store import materialize

WHITE = " \t\n\x0b\x0c\r"
#: Of the bitmap of frequent lines: at most 2**18 words.
_BITS = 24


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def _hash(key: Column) -> list[Column]:
    """128 bits: at 10**13 lines no two keys are expected to meet."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def frequent_line_positions(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, text_hash, drop): where each document has lines that ``min_docs`` documents or more have.

    Counts are added up before they are shuffled.  Lines meet the frequent ones in joins of written tables, so that a line
    that most documents have can be split over tasks.  How many lines are frequent has no bound, so they are never broadcast:
    a bitmap of fixed size is, which keeps most other lines from being shuffled, and the join decides.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    loose = F.transform(_lines(F.lower("text")), lambda line: F.btrim(line, F.lit(WHITE)))
    each = rows.select(F.explode(F.array_distinct(loose)).alias("key")).where(F.length("key") >= min_chars)
    often = each.select(*_hash(F.col("key"))).groupBy("h1", "h2").count().where(F.col("count") >= min_docs).select("h1", "h2")
    often = materialize(often, "often")
    placed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    loose_hash = _hash(F.btrim(F.lower("line"), F.lit(WHITE)))
    candidates = (
        only_maybe_in(placed.select("*", *loose_hash), bitmap_words(often, "h1", _BITS), "h1", _BITS)
        .join(often.hint("merge"), ["h1", "h2"], "left_semi")
        .select("doc_id", "text_hash", "at", _key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "at", *_hash(F.col("key")))
    )
    candidates = materialize(candidates, "line-candidates")
    frequent = candidates.select("h1", "h2", "doc_id", "text_hash").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_docs)
    frequent = materialize(frequent.select("h1", "h2"), "frequent")
    found = candidates.join(frequent.hint("merge"), ["h1", "h2"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("drop"))
    return materialize(found, "drops")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with frequent lines taken out of ``text``, and the columns ``__n_lines`` and ``__n_dropped``, which replace
    any of these names.  Inside, a row of ``docs`` is one column, so no name clashes."""
    drops = frequent_line_positions(docs, min_docs, min_chars).select(F.col("doc_id").alias("id"), "text_hash", "drop")
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc")).select("doc", F.xxhash64(text).alias("own_hash"))
    joined = rows.join(drops.hint("merge"), F.col("id").eqNullSafe(F.col("doc.doc_id")) & (F.col("text_hash") == F.col("own_hash")), "left")
    cut = joined.select("doc", "drop", text.alias("text"), F.when(F.col("drop").isNotNull(), _lines(text)).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    left = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    counts = {"__n_lines": n_lines.cast("long"), "__n_dropped": F.coalesce(F.size("drop"), F.lit(0)).cast("long")}
    others = [F.col("doc").getField(c).alias(c) if c != "text" else left.alias("text") for c in docs.columns if c not in counts]
    return cut.select(*others, *[v.alias(k) for k, v in counts.items()])
