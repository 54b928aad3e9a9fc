import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haloforge.llm import packing, queries, store, tokenfile, tokens
from haloforge.llm.tokens import WordEncoder, encoder

from .conftest import DATA, ODD_TEXTS


def whole(text, end):
    ids = encoder(queries.tokenizer_path()).library.encode(text or "", add_special_tokens=False).ids + [end]
    return np.array(ids, dtype="<u4")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB .,'-é<|>\n\t\xa0\x1cß3#"), st.characters()), max_size=30), max_size=5))
def test_words_encode_as_whole_texts(texts):
    mine = encoder(queries.tokenizer_path())
    texts = [t.encode("utf-8", "replace").decode() for t in texts] + ["<|endoftext|> A<|ENDOFTEXT|>", "don't we'll .'s"]
    ids, first = mine.encode(texts)
    for k, text in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == mine.library.encode(text, add_special_tokens=False).ids


def thue_morse(n):
    """Two words whose hashes by any polynomial modulo 2**64 are equal."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_equal_polynomials(spark):
    a, b = thue_morse(2048)
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{b} {a}")], "doc_id long, text string")
    path = store.new_path(spark, "test")
    tokenfile.write_tokens(docs, path, queries.tokenizer_path(), 2)
    for r in tokenfile.read_tokens(spark, path, with_ids=True).collect():
        assert r.ids == whole({1: a, 2: b, 3: f"{b} {a}"}[r.doc_id], 2).tolist()
    check_packing(packing.pack(docs, queries.tokenizer_path(), 1).toPandas(), {1: a, 2: b, 3: f"{b} {a}"}, 1)


def test_words_whose_hashes_meet(monkeypatch):
    """Hashes only find words; their bytes decide."""
    mine = WordEncoder(queries.tokenizer_path())
    monkeypatch.setattr(tokens, "span_hashes", lambda buf, starts, ends: ((ends - starts) % 3).astype(np.uint64))
    for texts in (["one two three", "four five six", "seven"], ["eight nine one", "ten", ""]):
        ids, first = mine.encode(texts)
        for k, text in enumerate(texts):
            assert ids[first[k] : first[k + 1]].tolist() == mine.library.encode(text, add_special_tokens=False).ids


def test_token_file_orders_rows_of_one_id(spark):
    rows = [(5, f"text {k}") for k in range(40)] + [(4, None), (6, "x")]
    order = []
    for n in (1, 7):
        path = store.new_path(spark, "test")
        tokenfile.write_tokens(spark.createDataFrame(rows[::-1] if n > 1 else rows, "doc_id long, text string").repartition(n), path, queries.tokenizer_path(), 2)
        order.append([r.ids for r in tokenfile.read_tokens(spark, path, with_ids=True).orderBy("start").collect()])
    assert order[0] == order[1] and len(order[0]) == 42


def test_a_full_table_starts_anew():
    small = WordEncoder(queries.tokenizer_path(), most=8)
    for text in ["one two three", "four five six seven", "eight nine ten one two three four five six seven eleven"]:
        assert small.encode([text])[0].tolist() == small.library.encode(text, add_special_tokens=False).ids


def check_packing(pieces, texts, end, length=2048):
    for key, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        ids = whole(texts[key], end)
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        at = 0
        for _, p in own.iterrows():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= length


def test_packing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = queries.op1_packing(spark, DATA).toPandas()
    assert set(pieces.doc_id) == set(texts)
    check_packing(pieces, texts, 1)
    used = pieces.groupby("sequence_id").length.sum()
    assert used.sum() / (2048 * len(used)) > 0.97


@pytest.mark.parametrize("top_up", [True, False])
def test_packing_odd_rows(spark, odd_docs, top_up):
    pieces = packing.pack(odd_docs.where("doc_id <> 9"), queries.tokenizer_path(), 1, length=64, open_windows=2, top_up=top_up, with_ids=True).toPandas()
    check_packing(pieces, dict(enumerate(ODD_TEXTS)), 1, 64)
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(pieces.ids, pieces.ids_crc32, strict=True))
    pieces = packing.pack(odd_docs, queries.tokenizer_path(), 1).toPandas()
    assert (pieces.doc_id == 9).sum() == 2 and pieces.doc_id.isna().sum() == 1


def test_packing_nothing(spark, no_docs):
    assert packing.pack(no_docs, queries.tokenizer_path(), 1).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300))
def test_ranks_round_trip(ids):
    assert tokenfile.decode_ranks(*tokenfile.encode_ranks(np.array(ids)), len(ids)).tolist() == ids


def test_long_ranks_round_trip():
    ids = np.concatenate([np.arange(70_000), np.arange(70_000) % 7])
    assert (tokenfile.decode_ranks(*tokenfile.encode_ranks(ids), len(ids)) == ids).all()


def test_token_file(spark):
    docs = sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda r: r.doc_id)
    found = queries.op3_token_file(spark, DATA).orderBy("doc_id").collect()
    at = 0
    for doc, row in zip(docs, found, strict=True):
        ids = whole(doc.text, 2)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_file_odd_rows(spark, odd_docs, no_docs):
    path = store.new_path(spark, "test")
    tokenfile.write_tokens(odd_docs, path, queries.tokenizer_path(), 2, segment_tokens=50)
    rows = tokenfile.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, *range(10), 9, 10]
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    for r in rows[1:]:
        assert r.ids == whole(ODD_TEXTS[r.doc_id], 2).tolist()
    path = store.new_path(spark, "test")
    tokenfile.write_tokens(no_docs, path, queries.tokenizer_path(), 2)
    assert tokenfile.read_tokens(spark, path).count() == 0
