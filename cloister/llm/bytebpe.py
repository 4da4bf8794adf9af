"""Byte-level BPE by tree reduction: ids of texts from a file of ranks, and texts from ids.

Token sequences of byte strings form a monoid: its product of enc(a) and enc(b) is enc(a + b).  A piece of text is cut in
halves down to a few bytes, and neighbours are joined on the way up.  A join encodes a window around the boundary anew
and widens it until nothing outside can change:

    A sequence of tokens is an encoding if each pair of neighbours t, u is stable, that is, if enc(t + u) is [t, u].
    For look at the first merge that would cross a border between tokens.  Up to then, the bytes of t and u on both sides of
    that border have merged among themselves in the order in which they do in t + u alone, so the merge would cross it there too.

So it is enough that both ends of the window are stable with the tokens next to it; at worst the window is everything.
Matches of the pattern never merge with each other, so those products are plain concatenations.  Decoding maps ids to
bytes, which concatenate up the tree.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, texts

#: Bytes of a leaf of the tree; leaves are as long as each other but for the last, so repeated bytes split alike.
LEAF = 8
#: Characters that are split into pieces at once, and ids that are decoded at once.
SPLIT_CHARS, DECODE_IDS = 1 << 16, 1 << 14
#: Pieces in a worker's cache with the longest of them, and pairs of tokens known to be stable or not.
CACHE_PIECES, CACHE_CHARS, CACHE_PAIRS = 500_000, 40, 250_000
#: Bytes up to which pairs are looked through instead of kept in a heap, and the rank of pairs without one.
SHORT, _NONE = 48, 1 << 62


class RankEncoder(dict):
    """Ids of texts as the bytes of little-endian unsigned 32-bit integers, by the ranks of a file.

    It is itself the cache of pieces.  ``ranks`` has a rank for each of the 256 bytes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("each single byte needs a rank")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.ids = {token: np.uint32(rank).astype("<u4").tobytes() for token, rank in ranks.items()}
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    # Joining.

    def merge(self, data: bytes) -> list[bytes]:
        """The encoding of some bytes from their definition: the pair of least rank, the first of equals, is merged until none has a rank."""
        if len(data) > SHORT:
            return self._merge_long(data)
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        ranks = [rank(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], _NONE)
        return parts

    def _merge_long(self, data: bytes) -> list[bytes]:
        """The same by a heap of pairs."""
        parts, after, before = [data[i : i + 1] for i in range(len(data))], list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        rank, end = self.ranks.get, len(data)
        heap = [(r, i, 2) for i in range(end - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j == end or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been merged with another since
            parts[i], parts[j], after[i] = parts[i] + parts[j], b"", after[j]
            if after[j] < end:
                before[after[j]] = i
                if (r := rank(parts[i] + parts[after[j]])) is not None:
                    heapq.heappush(heap, (r, i, size + len(parts[after[j]])))
            k = before[i]
            if k >= 0 and (r := rank(parts[k] + parts[i])) is not None:
                heapq.heappush(heap, (r, k, len(parts[k]) + size))
        return [p for p in parts if p]

    def stable(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay apart next to each other."""
        found = self.pairs.get((left, right))
        if found is None:
            found = self.merge(left + right) == [left, right]
            if len(self.pairs) < CACHE_PAIRS:
                self.pairs[left, right] = found
        return found

    def join(self, a: list[bytes], b: list[bytes]) -> list[bytes]:
        """The product: the encoding of what ``a`` and ``b`` encode, one after the other."""
        if not a or not b or self.stable(a[-1], b[0]):
            return a + b
        i, j = len(a) - 1, 1  # the window is a[i:] and b[:j]
        while True:
            window = self.merge(b"".join(a[i:] + b[:j]))
            left, right = i == 0 or self.stable(a[i - 1], window[0]), j == len(b) or self.stable(window[-1], b[j])
            if left and right:
                return a[:i] + window + b[j:]
            i = i if left else max(0, 2 * i - len(a))
            j = j if right else min(len(b), 2 * j)

    def tree(self, data: bytes) -> list[bytes]:
        """The encoding of some bytes, by halves."""
        if len(data) <= LEAF:
            return self.merge(data)
        half = LEAF << ((len(data) - 1) // LEAF).bit_length() - 1
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    # Texts.

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        ids = self.ids.get(data) or b"".join(map(self.ids.__getitem__, self.tree(data)))  # a piece that has a rank is one token
        if len(piece) <= CACHE_CHARS and len(self) < CACHE_PIECES:
            self[piece] = ids
        return ids

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, some at a time.  A match that touches the end of what is looked at is found again with more."""
        at, size = 0, SPLIT_CHARS
        while at < len(text):
            found = self.pattern.findall(text, at, at + size)
            if at + size < len(text):
                if len(found) < 2:
                    size *= 2
                    continue
                found.pop()
            yield found
            at, size = at + sum(map(len, found)), SPLIT_CHARS

    def encode(self, text: str | None) -> bytes:
        return b"".join(b"".join(map(self.__getitem__, found)) for found in self.pieces(text or ""))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; an id without a token is an error."""
        if len(ids) > 4 * DECODE_IDS:
            half = 4 * DECODE_IDS << ((len(ids) - 1) // (4 * DECODE_IDS)).bit_length() - 1
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


_encoders: dict[tuple[str, str], RankEncoder] = {}


def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """The worker's encoder of a file of ranks; its path is the same on all machines."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = RankEncoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: each row's ids as the bytes of little-endian unsigned 32-bit integers, in a narrow pass.

    Each match of ``pattern`` is encoded by itself; what no match holds has no ids.  No string is a special token.  A
    null or empty text has no ids, a text of any length is encoded whole, repeated rows and rows without an id are each
    encoded, other columns are not looked at, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(ranks_path, pattern).encode
        for batch in batches:
            ids = pa.array([encode(value.as_py()) for value in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return texts(docs, doc_id, text).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids") -> DataFrame:
    """The table with ``decoded``, the bytes that ``ids`` stand for, after its columns (a column of that name is replaced).

    Null ids give null; an id that the file does not have is an error.
    """
    kept = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != "decoded"])
    place = kept.columns.index(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = rank_encoder(ranks_path, pattern).decode
        for batch in batches:
            out = pa.array([None if (value := row.as_py()) is None else decode(value) for row in batch.column(place)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, schema)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of all ``documents``."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = decode_documents(encode_documents(read_table(spark, sf_dir, "documents"), path), path)
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
