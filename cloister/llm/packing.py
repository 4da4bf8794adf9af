"""Best-fit packing of token pieces by minimum bin slack.

Only the number of pieces of each length matters for the packing, so it is planned on a histogram of
at most ``capacity`` counts.  For each bin, a subset-sum over the available lengths, held as bits of
one integer, finds the fullest feasible combination that holds the largest remaining length; the
combination is taken out as often as the counts allow.  Lengths join the sum from the largest down, and a bin that is full but
for an allowed slack takes no shorter ones, which are then left for bins that nothing else fills.  The histogram is
planned under each of a few slacks and the plan with the fewest bins is taken.  Pieces then find their place from their
length and their rank among the pieces of that length, in a narrow pass over a table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialise, read_table, texts

CAPACITY = 1024
END_ID = 2
#: Slacks under which the bins are planned.
SLACKS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _local long"


def fullest(counts: np.ndarray, capacity: int, slack: int = 0) -> list[int]:
    """Lengths, with repeats, whose sum is the largest that fits in ``capacity``; the largest available length is one of them.
    Lengths shorter than those that leave ``slack`` at most are not looked at.

    ``counts[l]`` pieces of length l are available.  Bit s of ``sums`` is set if some combination of
    the lengths so far has sum s; ``steps`` keeps the bits that each added piece made new.
    """
    largest = int(np.flatnonzero(counts)[-1])
    room = capacity - largest
    mask = (1 << (room + 1)) - 1
    enough = max(room - slack, 0)
    sums, steps = 1, []
    for length in [] if not enough else np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left = int(counts[length]) - (length == largest)
        for _ in range(min(left, room // length)):
            new = (sums << length) & mask & ~sums
            if not new:
                break
            sums |= new
            steps.append((length, new))
        if sums >> enough:
            break
    best = sums.bit_length() - 1
    chosen = [largest]
    for length, new in reversed(steps):
        if new >> best & 1:
            chosen.append(length)
            best -= length
    return chosen


def combinations(counts: np.ndarray, capacity: int, slack: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until no piece is left."""
    counts, out = counts.copy(), []
    while counts.any():
        chosen = fullest(counts, capacity, slack)
        lengths, need = np.unique(chosen, return_counts=True)
        times = int((counts[lengths] // need).min())
        counts[lengths] -= times * need
        out.append((chosen, times))
    return out


def plan_bins(counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Segments ``length, rank, bin, times, place``: pieces of ``length`` from rank ``rank`` on go to bins
    ``bin, bin + 1, ...``, one for each, at ``place``, until the next segment of that length.

    Of the plans under ``SLACKS`` it is that of the fewest bins, and of the least slack among those.
    """
    plans = [combinations(counts, capacity, slack) for slack in SLACKS]
    used, bins, rows = np.zeros_like(counts), 0, []
    for chosen, times in min(plans, key=lambda plan: sum(times for _, times in plan)):
        place = 0
        for length in chosen:
            rows.append((length, int(used[length]), bins, place))
            used[length] += times
            place += length
        bins += times
    return pd.DataFrame(rows, columns=["length", "rank", "bin", "place"]).astype("int64")


def _tokenised(path: str, capacity: int, end_id: int, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, added_tokens).encode, np.uint32(end_id).astype("<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                for k in range(len(cuts) - 1):
                    a, b = cuts[k], cuts[k + 1]
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(value)
            lengths = np.array(out[3], np.int64)
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            within = np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
            local = np.empty(len(lengths), np.int64)
            local[order] = within + seen[ordered]
            seen += np.bincount(lengths, minlength=capacity + 1)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(out, types, strict=True)), pa.array(np.full(len(lengths), task, np.int32)), pa.array(local)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_local"],
            )

    return run


def _placed(plan: pd.DataFrame):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments = {length: (g["rank"].to_numpy(), g["bin"].to_numpy(), g["place"].to_numpy()) for length, g in plan.groupby("length")}
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                first, bins, places = segments[length]
                at = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows] = bins[at] + ranks[rows] - first[at]
                offset[rows] = places[at]
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", added_tokens: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row for each piece.

    A document's ids are the tokenizer's and ``end_id``; with ``added_tokens`` those of an unmodified ``encode``, which
    finds the file's added tokens in texts.  Only a document of more than ``capacity``
    ids is cut: the last pieces are full, the first holds the rest.  A null or empty text is a piece of
    one id, and repeated rows are packed each.  Sequences are numbered from 0; pieces lie in them
    without gaps from offset 0.  An empty table has no sequences.
    """
    plain = texts(docs, doc_id, text)
    # The table fixes which task numbered which piece, so a lost executor changes no rank.
    pieces = materialise(plain.mapInArrow(_tokenised(tokenizer_path, capacity, end_id, added_tokens), _PIECES), "pieces")
    per_task = pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = materialise(per_task.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    plan = plan_bins(counts, capacity)
    # One row for each length and task grows with the tasks, so it goes to the pieces by a shuffle, whatever its size.
    ranked = pieces.join(per_task.hint("shuffle_hash"), ["length", "_task"]).withColumn("_rank", F.col("_local") + F.col("_before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "_rank").mapInPandas(
        _placed(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)
