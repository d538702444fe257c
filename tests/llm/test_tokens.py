import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import byte_bpe, pieces, token_counts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    letters = [chr(i) for i in range(0x3100)] + [" "] * 3000 + ["'s", "'ll"] * 200 + list("abcdefgh") * 300
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    return texts + ["", " ", "  ", "\n \n a", "  a  b ", "don't we'll I'VE x's's '' 's", "a  b", " 　 a", "a" * 5000, "ab" * 2000 + " x",
                    "the" * 900, "a <|endoftext|> b", "x<|endoftext|>y", "<|endoftext|> <|endoftext|>"]


def ids(encoded):
    return np.frombuffer(encoded, np.int32).tolist()


def test_encoding_equals_the_library(library, odd_texts):
    got = byte_bpe.encode_texts(odd_texts, PATH, PATTERN)
    assert [ids(g) for g in got] == [library.encode_ordinary(t) for t in odd_texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text_round_trips(texts):
    words = byte_bpe.vocabulary(PATH, PATTERN)
    for text, encoded in zip(texts, byte_bpe.encode_texts(texts, PATH, PATTERN), strict=True):
        assert words.decode(np.frombuffer(encoded, np.int32)).tobytes() == text.encode()


def test_memo_stays_bounded_and_right(library, monkeypatch):
    words = byte_bpe.vocabulary(PATH, PATTERN)
    memo = pieces.Memo(words.encode_pieces, limit=10)
    for start in range(0, 100, 5):
        batch = [f"word{i}" for i in range(start, start + 5)] + ["common", "y" * 500]
        memo.learn(batch)
        assert [ids(memo[p]) for p in batch] == [library.encode_ordinary(p) for p in batch]
        assert len(memo) <= 12


def test_cut_pieces_join_to_the_text(odd_texts):
    for text in odd_texts:
        assert " ".join(pieces.cut(text)) == text


def test_encode_and_decode_tables(make_docs, odd_rows, library):
    docs = make_docs(odd_rows)
    got = byte_bpe.encode(docs, PATH, PATTERN, ids="token_ids")
    assert got.columns == [*docs.columns, "token_ids"]
    back = byte_bpe.decode(got, PATH, PATTERN, ids="token_ids").collect()
    assert len(back) == len(odd_rows)
    for r in back:
        assert r.token_ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    one = byte_bpe.encode(docs, PATH, PATTERN, decoded="body").collect()
    assert all(bytes(r.body) == (r.text or "").encode() for r in one)
    assert byte_bpe.encode(make_docs([]), PATH, PATTERN).collect() == []
    assert byte_bpe.decode(byte_bpe.encode(make_docs([]), PATH, PATTERN), PATH, PATTERN).collect() == []


def test_counts_equal_the_library(odd_texts):
    library = Tokenizer.from_file(JSON)
    assert token_counts.count_tokens(odd_texts, JSON) == [len(e.ids) for e in library.encode_batch(odd_texts, add_special_tokens=False)]


def test_count_table_and_its_cache(spark, make_docs, odd_rows, tmp_path, monkeypatch):
    library = Tokenizer.from_file(JSON)
    folder = f"file://{tmp_path}/cache"
    got = token_counts.token_counts(make_docs(odd_rows), JSON, cache=folder, limit=60)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 60) for i, t in odd_rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    stored = spark.read.parquet(folder)
    assert stored.count() == len({t or "" for _, t in odd_rows})
    # what is stored is taken, not counted again; only the new text is added
    monkeypatch.setattr(token_counts, "tokenizer_digest", lambda path: "other")
    marked = stored.selectExpr("content", "'other' as tokenizer", "n_tokens + 1000 as n_tokens")
    marked.write.mode("append").parquet(folder)
    again = token_counts.token_counts(make_docs([(1, "one"), (2, "brand new")]), JSON, cache=folder).collect()
    counts = {r.doc_id: r.n_tokens for r in again}
    assert counts == {1: 1000 + len(library.encode("one").ids), 2: len(library.encode("brand new").ids)}


def test_empty_tables(make_docs):
    assert token_counts.token_counts(make_docs([]), JSON).collect() == []
