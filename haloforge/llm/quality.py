"""Operator 5, quality rules: base rules and robust multivariate outliers, with DataFrame functions only.

Each document's statistics become a vector.  For each language and source, the centre and the scatter of the
``SUPPORT`` share of documents that lie closest together are sought (minimum covariance determinant): from two starts on, medians with median deviations and the mean with the
covariance of all, documents are ordered by Mahalanobis distance and the closest are averaged anew (C-steps), until no
determinant falls any more; the start that ends at the lesser one counts.  A document further than ``CUTOFF`` is an outlier.
A step passes the statistics once: sums and products are added up by narrow shells of distance before they are shuffled, and the
inmost shells up to the share are taken, so a source with most of the rows is no burden; groups' estimates are joined, never collected.

A language and source with fewer than ``LEAST`` documents that pass the
base rules is judged by the estimate over its whole language, and where that has fewer, too, by the one over all rows,
however few: every document is judged at every size.

A dimension's scatter counts as the larger of its own and ``FLOORS``, which adds nothing to a scatter above it: where nearly all documents of a group have the same value, a small
difference isn't an outlier.

Defined results: a null or empty text has no word and fails the base rules; a null language or source is a group of
its own; each row is judged, repeated rows alike; a null doc_id passes; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloforge.llm.store import drop_table, materialize

WHITE = " \\t-\\r"
#: The vector: ln of words, letters a word, ln of symbols a hundred words, of repeated lines and of repeated words a hundred words.
VECTOR = ("v1", "v2", "v3", "v4", "v5")
FLOORS = (0.5, 0.6, 0.7, 0.4, 0.8)
SUPPORT = 0.75
#: Shells of squared distance for each factor of e: rows in one, 3 % wide, count as equally far.  So do those nearer than the
#: first and further than the second of ``REACH``: the closest rows' mean is 5 / ``CONSISTENCY`` once an estimate has settled.
SHELLS = 32
REACH = (0.05, 100.0)
#: Steps go on until no group's ln of the determinant falls by more than STILL; shells let it rise a little.
STILL = 1e-3
MOST_STEPS = 40
LEAST = 40
#: Levels of estimates: 0 a language and source, 1 a language, 2 all rows.
GROUP = ("g_level", "g_lang", "g_source")
TOP = 2
#: Fixed values for five dimensions: the chi-square quantile at 0.999, and the factor that makes the scatter of the
#: closest 75 % consistent for normal vectors.
CUTOFF = 20.515
CONSISTENCY = 1.41
_POS = 28


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", f"[{WHITE}]+"), "").alias("words"), F.filter(F.split("text", "\n", -1), lambda line: line.rlike(f"[^{WHITE}]")).alias("lines"))
    rows = rows.select(
        "doc_id", "lang", "source", "words", F.size("words").alias("n"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # Windows of three words as one number each: a hash above, the place in the low bits.  Equal hashes of sorted
    # numbers are neighbours; only those windows are then compared as words.
    place = F.lit((1 << _POS) - 1)

    def coded(i: Column) -> Column:
        return F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).bitwiseAND(F.bitwise_not(place.cast("long"))).bitwiseOR(i.cast("long"))

    windows = F.when(F.col("n") >= 4, F.transform(F.sequence(F.lit(0), F.col("n") - 3), coded)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("coded", F.sort_array(windows))

    def meets(x: Column, i: Column) -> Column:
        top = F.shiftright(x, _POS)
        return F.coalesce(F.shiftright(F.get("coded", i - 1), _POS) == top, F.lit(False)) | F.coalesce(F.shiftright(F.get("coded", i + 1), _POS) == top, F.lit(False))

    rows = rows.withColumn("near", F.filter("coded", meets)).drop("coded")

    def spelled(x: Column) -> Column:
        i = x.bitwiseAND(place.cast("long")).cast("int")
        return F.struct(F.get("words", i).alias("a"), F.get("words", i + 1).alias("b"), F.get("words", i + 2).alias("c"), i.alias("i"))

    rows = rows.withColumn("spelled", F.when(F.size("near") > 0, F.sort_array(F.transform("near", spelled)))).drop("near", "words")

    def same(x: Column, other: Column) -> Column:
        return F.coalesce((x["a"] == other["a"]) & (x["b"] == other["b"]) & (x["c"] == other["c"]), F.lit(False))

    twice = F.filter("spelled", lambda x, i: same(x, F.get("spelled", i - 1)) | same(x, F.get("spelled", i + 1)))
    rows = rows.withColumn("twice", twice).drop("spelled")
    rows = rows.withColumn("at", F.sort_array(F.transform("twice", lambda x: x["i"]))).drop("twice")
    # Each window covers three words, less what the next one covers.
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda name: F.log1p(100 * F.col(name) / n)
    return [F.log(n).alias("v1"), (F.col("word_chars") / n).alias("v2"), rate("n_symbols").alias("v3"), rate("n_dup_lines").alias("v4"), rate("n_repeat_words").alias("v5")]


# Expressions over the vector's dimensions are written as SQL text: they are many, and each call of a Column's method costs a
# round trip to the JVM.
_D = range(len(VECTOR))
_PAIRS = [(i, j) for i in _D for j in range(i + 1)]
_CENTRE = [f"m{i}" for i in _D]
_FACTOR = [f"l{i}{j}" for i, j in _PAIRS]
_MOMENTS = [*[f"avg({v}) AS m{i}" for i, v in enumerate(VECTOR)], *[f"covar_pop({VECTOR[i]}, {VECTOR[j]}) AS c{i}{j}" for i, j in _PAIRS]]
#: ln of the scatter's determinant.
_LOG_DETERMINANT = " + ".join(f"2 * ln(l{i}{i})" for i in _D)
KEY = ("start", *GROUP)


def _distance(rows: DataFrame) -> DataFrame:
    """With d2, by forward substitution against the Cholesky factor l_ij and the centre m_i of the row's group."""
    for i, v in enumerate(VECTOR):
        rest = " - ".join([v, f"m{i}", *[f"l{i}{j} * y{j}" for j in range(i)]])
        rows = rows.selectExpr("*", f"({rest}) / l{i}{i} AS y{i}")
    return rows.selectExpr("*", " + ".join(f"y{i} * y{i}" for i in _D) + " AS d2")


def _factor(groups: DataFrame) -> DataFrame:
    """The keys, old, m_i and the scatter s_ij -> the keys, old, m_i, l_ij.  The bound on the diagonal makes it definite."""

    def rest(i: int, j: int) -> str:
        return " - ".join([f"s{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])

    for j in _D:
        groups = groups.selectExpr("*", f"sqrt(greatest({rest(j, j)}, 1e-6D)) AS l{j}{j}")
        groups = groups.selectExpr("*", *[f"({rest(i, j)}) / l{j}{j} AS l{i}{j}" for i in _D if i > j])
    return groups.select(*KEY, "old", *_CENTRE, *_FACTOR)


def _scatter(factor: float) -> list[str]:
    """s_ij from the covariance c_ij, with the bounds on the diagonal."""
    times = [f"double({factor}) * c{i}{j}" for i, j in _PAIRS]
    return [f"{_bounded(t, i) if i == j else t} AS s{i}{j}" for t, (i, j) in zip(times, _PAIRS, strict=True)]


def _joined(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` have level, lang and source."""
    same = (F.col("level") == F.col("g_level")) & F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return rows.join(groups, same, how)


def _bounded(variance: str, i: int) -> str:
    return f"greatest({variance}, double({FLOORS[i] ** 2}))"


def estimates(rows: DataFrame) -> DataFrame:
    """One row for each level, language and source with ``LEAST`` rows or more, and for the top level whatever it has: its
    centre m_i and Cholesky factor l_ij.  Rows without a level are all of level 0."""
    if "level" not in rows.columns:
        rows = rows.withColumn("level", F.lit(0))
    middle = [f"percentile_approx({v}, 0.5D, 10000) AS p{i}" for i, v in enumerate(VECTOR)]
    whole = rows.groupBy(*[F.col(c[2:]).alias(c) for c in GROUP]).agg(F.count("*").alias("n"), *map(F.expr, [*middle, *_MOMENTS]))
    # A written table, so that adaptive execution can split a group with most of the rows.
    whole = materialize(whole.where((F.col("n") >= LEAST) | (F.col("g_level") == TOP)), "groups")
    medians = [f"p{i}" for i in _D]
    spread = _joined(rows, whole.select(*GROUP, *medians)).groupBy(*GROUP, *medians)
    spread = spread.agg(*[F.expr(f"percentile_approx(abs({v} - p{i}), 0.5D, 10000) AS mad{i}") for i, v in enumerate(VECTOR)])
    apart = [f"{_bounded(f'pow(1.4826D * mad{i}, 2)', i) if i == j else '0D'} AS s{i}{j}" for i, j in _PAIRS]
    starts = spread.selectExpr("0 AS start", *GROUP, "double(null) AS old", *[f"p{i} AS m{i}" for i in _D], *apart)
    starts = starts.unionByName(whole.selectExpr("1 AS start", *GROUP, "double(null) AS old", *_CENTRE, *_scatter(1.0)))
    groups = materialize(_factor(starts), "groups")
    drop_table(whole)
    for _ in range(MOST_STEPS):
        before, groups = groups, materialize(_factor(_closest(rows, groups).selectExpr(*KEY, "old", *_CENTRE, *_scatter(CONSISTENCY))), "groups")
        drop_table(before)
        falls = groups.selectExpr(f"max(old - ({_LOG_DETERMINANT}))").first()[0]
        if falls is None or falls <= STILL:
            break
    # Of the starts, the one that ends at the lesser determinant.
    best = groups.groupBy(*GROUP).agg(F.min_by(F.struct(*_CENTRE, *_FACTOR), F.struct(F.expr(_LOG_DETERMINANT), "start")).alias("b"))
    return materialize(best.select(*GROUP, "b.*"), "groups")


def _closest(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """A C-step in one pass over the rows: ``KEY``, old (ln of the determinant so far), and of the closest rows the mean m_i and the
    covariance c_ij.  Moments about the centre are summed by shells of distance, which are few; the inmost shells are added up, the
    last of them by the share that makes their rows ``SUPPORT`` of all, so that the number is the same in each step."""
    off = [f"({v} - m{i})" for i, v in enumerate(VECTOR)]
    sums = {"n": "1"} | {f"t{i}": off[i] for i in _D} | {f"t{i}{j}": f"{off[i]} * {off[j]}" for i, j in _PAIRS}
    known = [f"first({c}) AS {c}" for c in ("old", *_CENTRE)]
    far = _distance(_joined(rows, groups.drop("old").selectExpr("*", f"{_LOG_DETERMINANT} AS old")))
    far = far.selectExpr(*KEY, *VECTOR, "old", *_CENTRE, f"floor({SHELLS} * ln(least(greatest(d2, double({REACH[0]})), double({REACH[1]})))) AS shell")
    shells = far.groupBy(*KEY, "shell").agg(*map(F.expr, [*known, *[f"sum({e}) AS {name}" for name, e in sums.items()]]))
    of = Window.partitionBy(*KEY)
    inside = F.coalesce(F.sum("n").over(of.orderBy("shell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = shells.select("*", (SUPPORT * F.sum("n").over(of) - inside).alias("room")).where("room > 0")
    near = near.selectExpr("*", "least(1D, room / n) AS share")
    near = near.groupBy(*KEY).agg(*map(F.expr, [*known, *[f"sum(share * {name}) AS {name}" for name in sums]]))
    return near.selectExpr(*KEY, "old", *[f"m{i} + t{i} / n AS m{i}" for i in _D], *[f"t{i}{j} / n - (t{i} / n) * (t{j} / n) AS c{i}{j}" for i, j in _PAIRS])


def _levels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that pass the base rules, at each level where an estimate is needed; and (own_lang, own_source, level,
    to_lang, to_source), where each language and source is judged."""
    sizes = rows.groupBy(F.col("lang").alias("own_lang"), F.col("source").alias("own_source")).agg(F.count_if(~F.col("base_failed")).alias("n"))
    by_lang = sizes.groupBy(F.col("own_lang").alias("of_lang")).agg(F.sum("n").alias("n_lang"))
    level = F.when(F.col("n") >= LEAST, 0).when(F.col("n_lang") >= LEAST, 1).otherwise(TOP)
    places = sizes.join(by_lang, F.col("own_lang").eqNullSafe(F.col("of_lang"))).select("own_lang", "own_source", level.alias("level"))
    places = materialize(places.withColumns({"to_lang": F.when(F.col("level") < TOP, F.col("own_lang")), "to_source": F.when(F.col("level") == 0, F.col("own_source"))}), "places")
    passed, none = rows.where("not base_failed"), F.lit(None).cast("string")
    out = passed.select(F.lit(0).alias("level"), "lang", "source", *VECTOR)
    pooled = places.where("level = 1").select("own_lang").distinct()
    out = out.unionByName(passed.join(pooled, F.col("lang").eqNullSafe(F.col("own_lang")), "left_semi").select(F.lit(1).alias("level"), "lang", none.alias("source"), *VECTOR))
    if not places.where(F.col("level") == TOP).isEmpty():
        out = out.unionByName(passed.select(F.lit(TOP).alias("level"), none.alias("lang"), none.alias("source"), *VECTOR))
    return out, places


def judge(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = materialize(statistics(docs).withColumn("base_failed", failed).select("*", *_vector()), "statistics")
    chosen, places = _levels(rows)
    at = rows.join(places, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")))
    rows = at.drop("lang", "source").withColumnsRenamed({"to_lang": "lang", "to_source": "source"})
    judged = _distance(_joined(rows, estimates(chosen), "left"))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance2"))
