"""Token ids in binary shard files: frequency-ranked, byte-aligned, with separate control bytes.

Ids are replaced by their rank in the corpus's frequency order, so most values take one byte.  Each
value is stored in 1 to 4 little-endian bytes; two control bits per value, four values to a control
byte, hold the number of bytes and stand apart from the data bytes.  Decoding looks the lengths of four
values up in a table by control byte and gathers whole blocks with numpy.

A shard file is ``CLTK``, then blocks, then a footer.  Block: four uint64 (documents n, values, control
bytes, data bytes), n validity bytes of the ids, n int64 doc ids, n uint64 lengths, control bytes, data
bytes.  Footer: uint64 2^64-1, uint64 documents, uint64 values.  ``ranks.u32`` holds the id of each rank.
A shard is written under a name of its own for each task attempt, and the manifest names the attempts
that succeeded: a lost executor or a speculative copy leaves no trace in what is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialise, read_table, scratch_path, texts

END_ID = 2
MAGIC = b"CLTK"
_FOOTER = 2**64 - 1

#: Chunks of text that a worker's encoder keeps.
CHUNKS = 500_000
#: Values in a block, and in a shard file on average.
BLOCK_VALUES = 1 << 20
SHARD_VALUES = 16 << 20

#: Control byte -> byte lengths of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values >= 1 << 8) + (values >= 1 << 16).astype(np.int8) + (values >= 1 << 24)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return control.astype(np.uint8), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(size > k)
        if not len(long):
            break
        out[long] |= data[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store and path that ``path`` names; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _tokenised(path: str, end_id: int, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pack = encoder(path, added_tokens, CHUNKS), zstandard.ZstdCompressor(level=1).compress
        kind = np.uint16 if own.vocabulary_size <= 1 << 16 and end_id < 1 << 16 else np.uint32
        end = np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            sizes, packed = [], []
            for text in batch.column(1):
                ids = np.frombuffer(own.encode(text.as_py()) + end, "<u4")
                sizes.append(len(ids))
                packed.append(pack(ids.astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "ids"])

    return run


def _unpack(n: int, packed: bytes, reader: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = reader.decompress(packed)
    return np.frombuffer(raw, f"<u{len(raw) // n}")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, reader = np.zeros(0, np.int64), zstandard.ZstdDecompressor()
    for batch in batches:
        for n, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.bincount(_unpack(n, packed.as_py(), reader))
            if len(counts) > len(total):
                counts[: len(total)] += total
                total = counts
            else:
                total[: len(counts)] += counts
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])


def _write_block(out, docs: list, sizes: list[int], values: list[np.ndarray]) -> None:
    control, data = encode_values(np.concatenate(values))
    out.write(struct.pack("<4Q", len(docs), sum(sizes), len(control), len(data)))
    out.write(np.array([d is not None for d in docs], np.uint8).tobytes())
    out.write(np.array([d or 0 for d in docs], "<i8").tobytes())
    out.write(np.array(sizes, "<u8").tobytes())
    out.write(control.tobytes())
    out.write(data.tobytes())


def _written(folder: str, rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, reader = TaskContext.get(), zstandard.ZstdDecompressor()
        name = f"shard-{context.partitionId():07d}-{uuid.uuid4().hex}.cltk"
        store, root = file_system(folder)
        out, total, first = None, [0, 0], None
        docs, sizes, values, held = [], [], [], 0
        for batch in batches:
            for doc, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(MAGIC)
                    first = doc
                docs.append(doc)
                sizes.append(n)
                values.append(rank_of[_unpack(n, packed.as_py(), reader)])
                held += n
                total = [total[0] + 1, total[1] + n]
                if held >= BLOCK_VALUES:
                    _write_block(out, docs, sizes, values)
                    docs, sizes, values, held = [], [], [], 0
        if out is None:
            return
        if docs:
            _write_block(out, docs, sizes, values)
        out.write(struct.pack("<3Q", _FOOTER, *total))
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([context.partitionId()], pa.int64()), pa.array([first], pa.int64()), pa.array([total[0]], pa.int64()), pa.array([total[1]], pa.int64())],
            names=["file", "part", "first_doc", "n_docs", "n_values"],
        )

    return run


def read_shard(path: str, id_of: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the documents of a shard file, a block at a time; a file that is no shard, or not whole, is a ``ValueError``."""
    store, name = file_system(path)
    with store.open_input_stream(name, compression=None) as src:

        def take(n: int) -> bytes:
            data = src.read(n)
            if len(data) < n:
                raise ValueError(f"{path} is cut short")
            return data

        if take(4) != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        seen = [0, 0]
        while True:
            (n,) = struct.unpack("<Q", take(8))
            if n == _FOOTER:
                break
            n_values, n_control, n_data = struct.unpack("<3Q", take(24))
            valid = np.frombuffer(take(n), np.uint8)
            docs = np.frombuffer(take(8 * n), "<i8")
            sizes = np.frombuffer(take(8 * n), "<u8").astype(np.int64)
            ids = id_of[decode_values(np.frombuffer(take(n_control), np.uint8), np.frombuffer(take(n_data), np.uint8), n_values)]
            seen = [seen[0] + n, seen[1] + n_values]
            ends = np.cumsum(sizes)
            for d in range(n):
                yield int(docs[d]) if valid[d] else None, ids[ends[d] - sizes[d] : ends[d]]
        if tuple(seen) != struct.unpack("<2Q", take(16)):
            raise ValueError(f"{path} holds other numbers of documents or values than its end says")


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", added_tokens: bool = False
) -> DataFrame:
    """Write ``docs`` as token shards in ascending doc_id order below ``folder``; the manifest, one row per shard:
    ``file, part, first_doc, n_docs, n_values, start`` with ``start`` the values of all shards before it.

    Ids are the tokenizer's and ``end_id``; with ``added_tokens`` those of an unmodified ``encode``, which finds the file's
    added tokens in texts.  A null text is empty; a null doc_id comes first; rows with equal doc_ids are ordered by length and content.  An empty table has a manifest without rows.
    """
    spark = docs.sparkSession
    plain = texts(docs, doc_id, text)
    tokens = materialise(plain.mapInArrow(_tokenised(tokenizer_path, end_id, added_tokens), "doc_id long, n long, ids binary"), "token-ids")
    seen = tokens.select("n", "ids").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = sorted(((-r["n"], r["id"]) for r in seen.collect()))  # at most a vocabulary
    id_of = np.array([i for _, i in ranks], "<u4")
    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of))
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/ranks.u32", compression=None) as out:
        out.write(id_of.tobytes())
    n_values = -sum(n for n, _ in ranks)
    parts = max(1, -(-n_values // SHARD_VALUES), min(spark.sparkContext.defaultParallelism, n_values // BLOCK_VALUES))
    tie = F.crc32("ids")
    ordered = tokens.repartitionByRange(parts, "doc_id", "n", tie).sortWithinPartitions("doc_id", "n", tie)
    manifest = materialise(ordered.mapInArrow(_written(folder, rank_of), "file string, part long, first_doc long, n_docs long, n_values long"), "shards")
    rows = sorted(manifest.collect(), key=lambda r: r["part"])  # one for each file
    starts = np.concatenate(([0], np.cumsum([r["n_values"] for r in rows]))).tolist()
    schema = "file string, part long, first_doc long, n_docs long, n_values long, start long"
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, starts[: len(rows)], strict=True)], schema)


#: Documents of a shard that a reader holds at once, besides a block of their ids.
READ_DOCS = 1 << 15


def _read(folder: str, id_of: np.ndarray):
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, start in zip(batch["file"], batch["start"], strict=True):
                rows = []
                for doc, ids in read_shard(f"{folder}/{file}", id_of):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == READ_DOCS:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    return run


def read_token_index(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the shard files."""
    store, root = file_system(folder)
    with store.open_input_stream(f"{root}/ranks.u32", compression=None) as src:
        id_of = np.frombuffer(src.read(), "<u4")
    files = manifest.select("file", "start")
    files = files.repartition(max(1, files.count()))  # each file is read by a task of its own
    return files.mapInPandas(_read(folder, id_of), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-shards")
    manifest = write_tokens(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), added_tokens=True)
    return read_token_index(manifest, folder)
