import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe_tree, token_store, tokens

LIBRARY = tokens.byte_bpe().library
PIECES = ["a" * 50, "abcabc", " the", "'s", "'", "''ll", "12", "  ", "\n\n", "é", "漢字", "🙂", "!!!?", "<|endoftext|>", "hello world. ", "\x1c", "-----"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.integers(1, 40))
def test_tree_equals_library(parts, leaf):
    text = "".join(parts)
    assert bpe_tree.encode_tree(tokens.byte_bpe(), text, leaf).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abrt hels'1.!é", max_size=200), st.integers(1, 60))
def test_tree_equals_library_on_random_text(text, leaf):
    assert bpe_tree.encode_tree(tokens.byte_bpe(), text, leaf).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


WORD_PIECES = [*PIECES, "CAFÉ", "Straße", "it's", "I'LL", "don't.", "x2y", "e\u0301", "İs", "ΟΔΟΣ", "ΣΑΣ.", "ﬁ", "\xa0", "\x85", "\u3000", "<|startoftext|>", "'S", "\x1f", "\x00", "Ünïcode,", "²", "ª", "ⅷ", "-", "th", "\u200b"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORD_PIECES), max_size=20) | st.lists(st.characters(max_codepoint=0x260), max_size=12))
def test_words_equal_library(parts):
    text = "".join(parts)
    assert tokens.word_bpe().encode(text).tolist() == tokens.word_bpe().library.encode(text, add_special_tokens=False).ids


def test_unsplit_text_is_joined_by_small_windows(monkeypatch):
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdefghij"), 20_000))
    encoder, seen = tokens.byte_bpe(), []
    parts = [np.array(encoder.encode(text[k : k + 1000])) for k in range(0, len(text), 1000)]
    plain = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda t: seen.append(len(t)) or plain(t), raising=False)
    got = bpe_tree.concatenate(encoder, parts)
    monkeypatch.undo()
    assert got.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert max(seen) < 500


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=2000), st.sampled_from([(8, 8, 16), (16, 16), (5, 7, 9, 11), (1, 31), (32,)]), st.data())
def test_shard_gives_any_range(ids, widths, data):
    widths = (16, 16) if widths == (32,) else widths
    shard = token_store.Shard(token_store.build(np.array(ids, np.uint32), widths))
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert shard.range(a, b).tolist() == ids[a:b]
    assert all(shard[i] == ids[i] for i in range(a, min(b, a + 3)))


def test_id_that_does_not_fit_is_an_error():
    with pytest.raises(ValueError):
        token_store.build(np.array([1 << 17]), (8, 8))


ROWS = [(3, "The cat's <|endoftext|> 12"), (1, None), (2, ""), (None, "x y"), (3, "The cat's <|endoftext|> 12"), (3, "other"), (7, "ab cd " * 9000), (8, "z" * 40_000), (9, "a\x1cb c É")]


def rows(spark, data=None):
    return spark.createDataFrame(ROWS if data is None else data, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS ids", "2 AS row", "3 AS t", "4 AS id")


def test_round_trip_query(spark):
    got = bpe_tree.bpe_round_trip(rows(spark)).collect()
    want = []
    for i, t in ROWS:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_ids_decode_to_the_texts(spark):
    got = bpe_tree.decode_ids(bpe_tree.encode_ids(rows(spark))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, t or "")) for i, t in ROWS)


def test_store_query(spark):
    library = tokens.word_bpe().library
    got = token_store.token_store(rows(spark)).orderBy("start").collect()
    start, want = 0, []
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, want))
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)


def test_empty_tables(spark):
    assert bpe_tree.bpe_round_trip(rows(spark, [])).count() == 0
    assert token_store.token_store(rows(spark, [])).count() == 0
