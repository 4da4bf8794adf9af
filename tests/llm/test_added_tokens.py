import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloister.llm.bpe import ChunkEncoder
from cloister.llm.packing import op9_best_fit_packing
from cloister.llm.tokens import op10_token_output

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ROWS = [(3, "a <|endoftext|> b"), (7, "<|startoftext|>The cat<|endoftext|><|endoftext|>"), (9, "plain text"), (12, None)]


def _whole(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_encode_like_whole_texts(path):
    rng, own, whole = random.Random(6), ChunkEncoder(path, added_tokens=True), _whole(path)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<", " ", "  ", "\n", "a", "Bc", "don't", "'s", "é", "e", "́", "12", "中", "_-."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert own.encode(text) == whole(text).tobytes(), text


def test_queries_use_added_tokens(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    start, want = 0, []
    for doc, text in ROWS:
        ids = np.append(_whole(WORD)(text), 2).astype("<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op10_token_output(spark, str(tmp_path)).collect()) == want
    want = [(doc, len(ids), zlib.crc32(ids.tobytes())) for doc, ids in ((d, np.append(_whole(BYTE)(t), 2).astype("<u4")) for d, t in ROWS)]
    for packed in (op9_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in packed.collect()) == want
