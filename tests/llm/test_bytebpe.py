"""Byte-level BPE against the tiktoken library, over whole texts."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cloister.llm import bytebpe
from cloister.llm.bytebpe import RankEncoder, decode_documents, encode_documents, op11_byte_bpe, rank_encoder, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def own() -> RankEncoder:
    return rank_encoder(PATH, public_tokenizers.PATTERN)


def ids(text: str) -> list[int]:
    return np.frombuffer(own().encode(text), "<u4").tolist()


def test_every_token_encodes_to_itself():
    assert all(own().tree(t) == [t] for t in RANKS)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab é'sll \n\t0９一二😀̈", max_size=200) | st.text("aAxyze", max_size=300))
def test_texts_as_the_library(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)
    assert own().decode(own().encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120), st.binary(max_size=120))
def test_join_is_the_encoding_of_both(a, b):
    e = own()
    assert e.join(e.merge(a), e.merge(b)) == e.merge(a + b) == e.tree(a + b)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=80), st.text("ab", max_size=80), st.permutations(range(12)))
def test_join_under_any_ranks(a, b, order):
    """Ranks in any order: merges may come late, ranks may fall from one merge to the next, and windows have to grow."""
    tokens = [b"ab", b"ba", b"aa", b"bb", b"aab", b"aba", b"abab", b"bab", b"aaaa", b"bba", b"babab", b"abba"]
    e = RankEncoder({bytes([i]): 1000 + i for i in range(256)} | {t: order[i] for i, t in enumerate(tokens)}, public_tokenizers.PATTERN)
    left, right = e.merge(a.encode()), e.merge(b.encode())
    if all(e.merge(t) == [t] for t in {*left, *right}):
        assert e.join(left, right) == e.merge((a + b).encode())


def test_long_pieces_and_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    long = ["a" * 5001, "".join(map(chr, rng.integers(97, 100, 4000))), " " * 3000 + "x", "ab" * 2000 + " " + "é" * 999, "\n " * 500, "x" + " \n" * 70]
    assert [ids(t) for t in long] == [REFERENCE.encode_ordinary(t) for t in long]
    text = " ".join("".join(map(chr, rng.integers(32, 900, rng.integers(1, 30)))) for _ in range(2000)) + "  \n\n  y's"
    expected = REFERENCE.encode_ordinary(text)
    for chars, count in ((1, 1), (7, 3), (64, 100)):
        monkeypatch.setattr(bytebpe, "SPLIT_CHARS", chars)
        monkeypatch.setattr(bytebpe, "DECODE_IDS", count)
        assert ids(text) == expected and own().decode(own().encode(text)) == text.encode()


def test_caches_are_bounded(monkeypatch):
    for name in ("CACHE_PIECES", "CACHE_PAIRS"):
        monkeypatch.setattr(bytebpe, name, 5)
    e = RankEncoder(RANKS, public_tokenizers.PATTERN)
    text = " ".join(f"word{i} qqzx{i}jk" for i in range(300))
    assert np.frombuffer(e.encode(text), "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert len(e) <= 5 and len(e.pairs) <= 5


def test_bad_input():
    with pytest.raises(ValueError, match="byte"):
        RankEncoder({b"a": 0}, ".")
    with pytest.raises(KeyError):
        own().decode(np.array([50_256], "<u4").tobytes())


def test_tables(spark):
    rows = [(1, "Hello world", 5), (None, "a b", 6), (2, None, 7), (2, None, 7), (3, "", 8), (4, "<|endoftext|> x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("decoded", docs_extra())
    found = decode_documents(encode_documents(docs, PATH), PATH)
    assert found.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in found.collect()), key=repr)
    assert got == sorted(((d, REFERENCE.encode_ordinary(t or ""), (t or "").encode()) for d, t, _ in rows), key=repr)
    named = docs.withColumnRenamed("doc_id", "n").withColumnRenamed("text", "ids2")
    assert encode_documents(named, PATH, doc_id="n", text="ids2").count() == 6
    assert decode_documents(encode_documents(docs.where("false"), PATH), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None)], "k long, ids binary")
    assert decode_documents(nulls, PATH).collect()[0]["decoded"] is None


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("kept out")


def test_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in op11_byte_bpe(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        expected, r = REFERENCE.encode_ordinary(d["text"] or ""), found[d["doc_id"]]
        assert r["n_tokens"] == len(expected)
        assert r["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
