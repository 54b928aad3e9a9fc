"""Operators 11, 12 and 13: integer codebooks, divergence of sources, class bigrams."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from haloforge.llm import brown, divergence, queries, vectorcodes

from .conftest import DATA


def of_sql(name, **tables):
    con = duckdb.connect()
    for table, rows in tables.items():
        con.register(table, rows) if not isinstance(rows, str) else con.execute(f"create view {table} as select * from '{rows}'")
    return con.execute(queries.SQL[name]).df()


def alike(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    text = lambda df: sorted(tuple("null" if v is None or v != v else str(int(v)) if isinstance(v, (float, np.floating)) and v == int(v) else str(v) for v in r) for r in df[columns].itertuples(index=False, name=None))
    assert text(a) == text(b)


# Vector codes ---------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """With Python's integers, one vector after another."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], ""
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[list(cut[e][p]) for e in range(min(entries, len(kept)))] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            got = collections.defaultdict(list)
            for v in cut:
                got[near(p, v[p])[1]].append(v[p])
            for e, vs in got.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = collections.Counter()
    for (_, _, lab), f in zip(kept, found, strict=True):
        errors[lab] += sum(d for d, _ in f)
    return [(r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[r[2]]) for r, f in zip(kept, found, strict=True)], digest


def check_codes(spark, rows, n=3):
    df = spark.createDataFrame(rows, VECTORS).repartition(n).selectExpr("*", "label as code", "vec_id as error", "label as of_label")
    got = vectorcodes.compress(df).collect()
    want, digest = brute_codes(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in got} == ({digest} if want else set())


def test_codes_as_brute_force(spark):
    r = random.Random(4)
    rows = [(k * 3, [r.gauss(0, 0.3) for _ in range(16)], r.choice([0, 1, None])) for k in range(90)]
    rows += [rows[5]] * 40 + [(7, rows[5][1], 2)]  # one very common vector, repeated rows, a tie of ids' order
    check_codes(spark, rows)


def test_codes_of_odd_vectors(spark):
    """Nulls, NaN and infinities are left out, null ids and labels coded; fewer vectors than entries; values below zero go down."""
    v = [-0.00001] * 8 + [0.5] * 8
    bad = [(1, None, 1), (2, [*v[:15], None], 1), (3, [*v[:15], math.nan], 1), (4, [*v[:15], -math.inf], 1)]
    check_codes(spark, [*bad, (5, v, None), (None, v[::-1], None), (None, v[::-1], 3), (9, [0.0] * 16, 3)])
    assert vectorcodes.compress(spark.createDataFrame(bad, VECTORS)).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        vectorcodes.compress(spark.createDataFrame([(1, [1.0] * 12, 0)], VECTORS)).count()


def test_rounds_run_as_many_jobs_over_many_partitions(spark):
    """What a round gathers comes in one job, however many partitions it was shuffled to."""
    r = random.Random(5)
    rows = vectorcodes.integer_vectors(spark.createDataFrame([(k, [r.gauss(0, 0.3) for _ in range(16)], 0) for k in range(60)], VECTORS))
    settings = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(s) for s in settings]
    jobs, books = [], []
    try:
        for n in (2, 40):
            for name, value in zip(settings, (str(n), "false"), strict=True):
                spark.conf.set(name, value)
            spark.sparkContext.setJobGroup(f"rounds-{n}", "rounds")
            books.append(vectorcodes.codebooks(rows, rounds=3))
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{n}")))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for name, value in zip(settings, before, strict=True):
            spark.conf.set(name, value)
    assert (books[0] == books[1]).all()
    assert jobs[0] == jobs[1] > 0


def test_codes_of_the_table(spark):
    a = queries.op11_vector_codes(spark, DATA).toPandas()
    alike(a, of_sql("op11_vector_codes", embeddings=f"{DATA}/embeddings.parquet"))
    rows = vectorcodes.integer_vectors(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    books = vectorcodes.codebooks(rows)
    back = {r.vec_id: np.array(r.vector) for r in vectorcodes.decode(vectorcodes.encode(rows, books), books).collect()}
    error = {r.vec_id: r.error for r in vectorcodes.encode(rows, books).collect()}
    for r in rows.limit(50).collect():
        assert int(((np.array(r.vector) - (back[r.vec_id] * 4096 - 0.5)) ** 2).sum().round()) == error[r.vec_id]


# Divergence -----------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string"


def brute_audit(rows, least_docs, ranks):
    docs = [((r[2] or ""), (r[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least_docs)
        share = lambda ds: (lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept} | {"": c})(collections.Counter(t for d in ds for t in d[2]))
        q, by = share(own), {s: share([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        for s, p in by.items():
            pairs = [(o, sum(abs(p[t] - p2[t]) for t in kept)) for o, p2 in by.items() if o != s]
            terms = [(t, p[t] - q[t]) for t in kept if p[""][t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items)]
    return sorted(out)


def corpus(seed=5, n=400, n_sources=13):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("wo", "Ba", "é", "日", "x-y ", "q9") for b in "abcdefghij"]
    rows = []
    for k in range(n):
        s = 0 if r.random() < 0.34 else r.randrange(n_sources)  # a third of the rows in one source
        some = words[: 12 + 3 * s] if s % 2 else words[s:]
        rows.append((k, " ".join(r.choice(some) for _ in range(r.randrange(30))), r.choice(["en", "de", "en", None]), f"s{s}" if s != 3 else None))
    return rows + [(1, None, "en", "only"), (2, "", "fr", "a"), (2, "", "fr", "b"), (3, "rare words alone", "xx", "c"), *rows[:9]]


@pytest.mark.parametrize("heavy, tile, block", [(0.25, 512, 64), (2.0, 7, 2), (0.0, 5, 3), (0.6, 1, 1)])
def test_divergence_as_brute_force(spark, heavy, tile, block):
    """Heavy terms alone, light ones alone and both, in tiles of a few terms and sources, give equal sums."""
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "lang as term", "doc_id as n", "source as item", "text as value")
    got = divergence.audit(docs, least_docs=6, term_ranks=7, heavy=heavy, tile_terms=tile, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, 6, 7)


def test_light_pairs_in_small_steps(spark, monkeypatch):
    r = np.random.default_rng(3)
    n, terms = 9, 40
    absent = r.integers(1, 9, n)
    at = np.argwhere(r.random((n, terms)) < 0.3)
    share = r.integers(1, 50, len(at))
    dense = np.repeat(absent[:, None], terms, axis=1)
    dense[at[:, 0], at[:, 1]] = share
    for step in (1, 5, 1 << 20):
        monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", step)
        for low, high in ((np.arange(n), np.arange(n)), (np.array([0, 4]), np.array([1, 2, 8]))):
            want = np.abs(dense[low][:, None, :] - dense[high][None]).sum(axis=2)
            assert (divergence._light(at[:, 0], at[:, 1], share, absent, low, high, terms) == want).all()


def test_divergence_of_the_table_and_of_nothing(spark, odd_docs, no_docs):
    alike(queries.op12_source_divergence(spark, DATA).toPandas(), of_sql("op12_source_divergence", documents=f"{DATA}/documents.parquet"))
    assert divergence.audit(no_docs).count() == 0
    got = divergence.audit(odd_docs).collect()
    assert sorted((r.lang, r.source, r.item, r.value) for r in got) == [("", "", "s", 0), ("", "s", "", 0)]  # no term is kept
    whole = divergence.audit(odd_docs, least_docs=1)
    assert sorted(tuple(r) for r in whole.collect()) == brute_audit([(r.doc_id, r.text, r.lang, r.source) for r in odd_docs.collect()], 1, 50)


# Class bigrams --------------------------------------------------------------------------------------------------------


def tokens(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w] + [""]


def check_base(found, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    n = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, v = sum(n.values()), len(n)
    want = collections.Counter()
    for i, t in rows:
        words = tokens(t)
        base = sum(math.log10((n[w] + 0.1) / (total + 0.1 * (v + 1))) for w in words)
        want[i, held(i), len(words), sum(n[w] > 0 for w in words), total, round(base, 6) + 0.0] += 1
    assert want == collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6) + 0.0) for r in found)


def two_kinds(seed=2, n=300):
    """Texts where words of two sorts alternate, so that two classes tell what comes next."""
    r = random.Random(seed)
    sorts = [[f"{c}{k}" for k in range(20)] for c in "ab"]
    return [(k, " ".join(r.choice(sorts[j % 2]) for j in range(r.randrange(2, 40)))) for k in range(n)]


def test_exchange_gain_is_the_likelihood(spark):
    """The gain of each class is what the likelihood, counted anew, rises by."""
    r = np.random.default_rng(1)
    seq = np.concatenate([[0], r.integers(1, 12, 4000)])
    kind = np.concatenate([[0], r.integers(1, 5, 11)])

    def grid(kind):
        out = np.zeros((6, 6), dtype=np.int64)
        np.add.at(out, (kind[seq[:-1]], kind[seq[1:]]), 1)
        return out

    for w in (3, 7):
        after, before = np.zeros(6, dtype=np.int64), np.zeros(6, dtype=np.int64)
        np.add.at(after, kind[seq[1:][seq[:-1] == w]], 1)
        np.add.at(before, kind[seq[:-1][seq[1:] == w]], 1)
        gains = brown.exchange_gains(grid(kind), kind[w], after, before, int(((seq[:-1] == w) & (seq[1:] == w)).sum()))
        for b in range(1, 5):
            moved = kind.copy()
            moved[w] = b
            rise = brown.likelihood(grid(moved)) - brown.likelihood(grid(kind))
            assert rise == pytest.approx(gains[b] - gains[kind[w]], abs=1e-6)


def test_classes_are_found(spark):
    """The likelihood rises from round to round, and both sorts have classes of their own."""
    docs = spark.createDataFrame(two_kinds(), "doc_id long, text string")
    blocks = brown.encode(docs)
    words = [b"", *sorted({w.encode() for _, t in two_kinds() for w in t.split()})]
    kind, grids = brown.head_classes(blocks, words, classes=5, rounds=12)
    rises = np.diff([brown.likelihood(g) for g in grids])
    assert rises.sum() > 0 and (rises > -1e-6 * abs(brown.likelihood(grids[0]))).all()
    classes = {c: {int(kind[k]) for k, w in enumerate(words) if w[:1] == c} for c in (b"a", b"b")}
    assert not classes[b"a"] & classes[b"b"] and kind[0] == 0 and 0 not in classes[b"a"] | classes[b"b"]


@pytest.mark.parametrize("heads", [8, 1 << 14])
def test_model_beats_words_alone(spark, heads):
    """With few heads nearly all words get their class in the last exchange; held-out texts are told better than by words alone."""
    rows = two_kinds()
    found = brown.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), classes=8, heads=heads).collect()
    check_base(found, rows)
    held = [r for r in found if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)
    for r in found:
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_model_is_the_same_however_rows_lie(spark, monkeypatch):
    rows = two_kinds(n=120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = {r.doc_id: r.score for r in brown.score(df.repartition(1), classes=6, heads=16, rounds=4).collect()}
    b = {r.doc_id: r.score for r in brown.score(df.repartition(7), classes=6, heads=16, rounds=4).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)


def test_probabilities_add_up(spark):
    """After any class, all known words, the end and "unknown" have probability 1 together."""
    r = np.random.default_rng(6)
    n_words = r.integers(1, 50, 30)
    kind = r.integers(0, 4, 30)
    grid = np.zeros((256, 256), dtype=np.int64)
    seq = np.repeat(np.arange(30), n_words)
    r.shuffle(seq)
    np.add.at(grid, (kind[seq], kind[np.roll(seq, -1)]), 1)  # in a circle, as texts' ends and beginnings are one
    table = brown.transitions(grid, int((n_words == 1).sum()))
    for before in (*range(4), brown.UNKNOWN):
        assert sum(10 ** table[before, kind[w]] * n_words[w] for w in range(30)) + 10 ** table[before, brown.UNKNOWN] == pytest.approx(1.0)


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    found = brown.score(odd_docs).collect()
    check_base(found, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in found) and brown.score(no_docs).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    alone = brown.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (alone.train_tokens, alone.n_known, alone.base_score) == (0, 0, 0.0) and math.isfinite(alone.score)


def test_scores_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = queries.op13_class_model(spark, DATA).collect()
    check_base(found, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
