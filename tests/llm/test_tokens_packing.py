import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloister.llm import tokens
from cloister.llm.bpe import ChunkEncoder
from cloister.llm.packing import fullest, pack_documents, plan_bins
from cloister.llm.tokens import decode_values, encode_values, read_token_index, write_tokens

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def _whole(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_encode_like_whole_texts(path):
    rng, own, whole = random.Random(4), ChunkEncoder(path), _whole(path)
    alphabet = "aAbB  \n\t'sS'llé́İΣσ\xa0\x85\x1c\x1f 中12<|endoftext|>_-. \r\n​\U0001f600\x01"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["x" * 5000, "don't stop", "", None]
    for text in texts * 2:
        assert own.encode(text) == whole(text).tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**17), st.integers(0, 2**32 - 1)), max_size=60))
def test_codec_round_trip(values):
    values = np.array(values, np.uint32)
    control, data = encode_values(values)
    assert len(control) == -(-len(values) // 4)
    assert (decode_values(control, data, len(values)) == values).all()


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, start string, n int")


ROWS = [(9, "The cat sat on the mat"), (3, None), (4, ""), (7, "a b " * 3000), (1, "é İ 中 <|endoftext|> x"), (7, "a b " * 3000), (12, "the the the")]


def test_shards_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_VALUES", 50)
    monkeypatch.setattr(tokens, "SHARD_VALUES", 4000)
    rows = [*ROWS, *((100 + i, f"word{i} and more") for i in range(200))]
    folder = str(tmp_path / "out")
    manifest = write_tokens(_docs(spark, rows), folder, WORD)
    assert {r["file"] for r in manifest.collect()} <= set(os.listdir(folder))
    assert manifest.count() > 1
    whole, start, want = _whole(WORD), 0, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = np.append(whole(text), 2).astype("<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in read_token_index(manifest, folder).collect()) == want


def test_cut_shard_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "out")
    name = write_tokens(_docs(spark, ROWS), folder, WORD).first()["file"]
    path = f"{folder}/{name}"
    size = os.path.getsize(path)
    for length in (size - 16, size - 24, size // 2, 10, 3):
        with open(path, "r+b") as f:
            f.truncate(length)
        with pytest.raises(ValueError, match="cut short"):
            list(tokens.read_shard(path, np.arange(60_000, dtype="<u4")))


def test_no_documents(spark, tmp_path):
    folder = str(tmp_path / "out")
    manifest = write_tokens(_docs(spark, []), folder, WORD)
    assert read_token_index(manifest, folder).collect() == []
    assert pack_documents(_docs(spark, []), BYTE).collect() == []


def test_null_id(spark, tmp_path):
    folder = str(tmp_path / "out")
    manifest = write_tokens(_docs(spark, [(None, "a"), (5, "b")]), folder, WORD)
    assert [(r["doc_id"], r["start"]) for r in read_token_index(manifest, folder).orderBy("start").collect()] == [(None, 0), (5, 2)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_fullest_is_a_best_subset(lengths):
    counts = np.bincount(lengths, minlength=31)
    chosen = fullest(counts, 30)
    sums = {0}
    rest = sorted(lengths)[:-1]
    for x in rest:
        sums |= {s + x for s in sums}
    assert sum(chosen) == max(s for s in sums if s + max(lengths) <= 30) + max(lengths)
    assert (np.bincount(chosen, minlength=31) <= counts).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=400))
def test_plan_places_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=65)
    plan = plan_bins(counts, 64)
    bins: dict[int, list[tuple[int, int]]] = {}
    for length in np.flatnonzero(counts):
        segments = plan[plan["length"] == length]
        for rank in range(counts[length]):
            row = segments[segments["rank"] <= rank].iloc[-1]
            bins.setdefault(row["bin"] + rank - row["rank"], []).append((row["place"], length))
    for content in bins.values():
        at = 0
        for place, length in sorted(content):
            assert place == at
            at += length
        assert at <= 64
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) <= 1.3 * sum(lengths) / 64 + sum(x > 32 for x in lengths) + 1


def test_pieces(spark):
    rows = [*ROWS, *((100 + i, "some words " * (i % 90)) for i in range(300))]
    got = [r.asDict() for r in pack_documents(_docs(spark, rows), BYTE, capacity=64).collect()]
    whole = _whole(BYTE)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(np.append(whole(text), 2).astype("<u4"))
    seen = {}
    for r in got:
        ids = texts[r["doc_id"]][0]
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert r["length"] == 64 or r["piece"] == 0
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {d: sum(map(len, x)) for d, x in texts.items()}
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * sum(seen.values()) / 64 + 1


def test_readers_hold_few_documents(spark, tmp_path, monkeypatch):
    """Shards are read a few documents at a time; all rows come back once, in whatever portions."""
    from cloister.llm import tokens

    folder = str(tmp_path / "out")
    rows = [(i, "word " * (i % 5)) for i in range(100)]
    manifest = write_tokens(_docs(spark, rows), folder, WORD)
    monkeypatch.setattr(tokens, "READ_DOCS", 7)
    id_of = np.fromfile(f"{folder}/ranks.u32", "<u4")
    parts = list(tokens._read(folder, id_of)(iter([manifest.select("file", "start").toPandas()])))
    assert max(map(len, parts)) <= 7
    assert sorted(d for part in parts for d in part["doc_id"]) == list(range(100))
