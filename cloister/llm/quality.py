"""Quality classification: random-indexing word vectors pooled per document, then a two-layer network.

Every word (run of letters, of digits or of other signs) has a sparse random index vector given by its
hash.  A word's vector is the sum of the index vectors of its neighbours over all documents, kept for
hashed words in a table of fixed size.  A document is pooled to the mean and the deviation of its
words' unit vectors, and the cosines of neighbouring ones.  A two-layer numpy network scores that; a temperature calibrates the score.
Gathering the word vectors and scoring each read the corpus once and shuffle only tables of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibrate import fit_temperature, held_out, softmax
from .common import read_table, texts
from .wordhash import Words, find_words, text_slices

#: Hashed words, dimensions of a vector, signs set in an index vector, neighbours on each side.
WORDS, DIMENSIONS, SIGNS, REACH = 8192, 32, 4, 2
_BLOCK = 256  # words in a row of partial sums

#: Bound of the fitted sample: labelled rows.
FIT_ROWS = 8000
#: A document below this score is rejected.
LEAST_SCORE = 0.7
FEATURES = 2 * DIMENSIONS + REACH + 1


def byte_classes() -> np.ndarray:
    """0 white space and control bytes, 1 letters and bytes of non-ASCII characters, 2 digits, 3 other signs."""
    table = np.full(256, 3, np.uint8)
    table[:33] = 0
    table[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    table[48:58] = 2
    return table


_CLASSES = byte_classes()


def quality_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are split where the class of the bytes changes: each class is found by itself and merged by place."""
    kind = _CLASSES[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.concatenate(([True], kind[1:] != kind[:-1])) | edge[:n] if n else np.empty(0, bool)
    runs = np.flatnonzero(change)
    bounds = np.concatenate((runs, [n])) if n else np.zeros(1, np.int64)
    # each run is a text of its own here, so that neighbouring words of different classes are kept apart
    found = find_words(data, bounds, _CLASSES_SPACE)
    return Words(found.starts, found.ends, np.searchsorted(found.starts, offsets), found.hashes)


_CLASSES_SPACE = _CLASSES == 0


def _neighbour_sums(words: Words, total: np.ndarray) -> None:
    """Add to ``total`` (words x dimensions, flat) the index vectors of each word's neighbours."""
    bucket = (words.hashes >> np.uint64(51)).astype(np.int64) * DIMENSIONS
    places = [((words.hashes >> np.uint64(8 * k)) & np.uint64(DIMENSIONS - 1)).astype(np.int64) for k in range(SIGNS)]
    signs = [((words.hashes >> np.uint64(8 * k + 7)) & np.uint64(1)).astype(np.float64) * 2 - 1 for k in range(SIGNS)]
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts)
    for reach in range(1, REACH + 1):
        if len(bucket) <= reach:
            break
        same = np.flatnonzero(owner[reach:] == owner[:-reach])
        for here, there in ((same, same + reach), (same + reach, same)):
            for k in range(SIGNS):
                total += np.bincount(bucket[here] + places[k][there], signs[k][there], len(total))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WORDS * DIMENSIONS)
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0)):
            _neighbour_sums(quality_words(data, offsets), total)
    rows = total.reshape(-1, _BLOCK * DIMENSIONS)
    used = np.flatnonzero(rows.any(axis=1))
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * _BLOCK * DIMENSIONS), pa.array(rows[used].ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), values], names=["block", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors (words, dimensions) from the neighbours in all texts; partial sums of fixed size are added up on the executors."""
    partial = texts(docs, None, text).mapInArrow(_gathered, "block int, sums array<double>")
    summed = partial.select("block", array_to_vector("sums").alias("v")).groupBy("block").agg(Summarizer.sum(F.col("v")).alias("v"))
    out = np.zeros((WORDS // _BLOCK, _BLOCK * DIMENSIONS))
    for row in summed.select("block", vector_to_array("v").alias("v")).collect():
        out[row["block"]] = row["v"]
    out = out.reshape(WORDS, DIMENSIONS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def document_features(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors of each text, mean cosines of words one and two apart (near one in text that
    repeats itself), and its size; zeros for a text without words."""
    words = quality_words(data, offsets)
    counts = words.counts
    out = np.zeros((len(counts), FEATURES), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        found = vectors[(words.hashes >> np.uint64(51)).astype(np.int64)]
        mean = np.add.reduceat(found, words.first[full], axis=0) / counts[full, None]
        square = np.add.reduceat(found * found, words.first[full], axis=0) / counts[full, None]
        out[full, :DIMENSIONS] = mean
        out[full, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
        owner = np.repeat(np.arange(len(counts)), counts)
        for reach in range(1, REACH + 1):
            same = np.flatnonzero(owner[reach:] == owner[:-reach])
            alike = np.einsum("nd,nd->n", found[same], found[same + reach])
            out[:, 2 * DIMENSIONS + reach - 1] = np.bincount(owner[same], alike, len(counts)) / np.maximum(counts - reach, 1)
        out[full, -1] = np.log1p(counts[full]) / 10
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    first: tuple[np.ndarray, np.ndarray]
    second: tuple[np.ndarray, np.ndarray]
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.maximum((features - self.mean) / self.scale @ self.first[0] + self.first[1], 0)
        return hidden @ self.second[0] + self.second[1]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return softmax(self.logits(features) / self.temperature)[:, 1]


def train(vectors: np.ndarray, features: np.ndarray, labels: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> QualityModel:
    """Two layers, by stochastic gradient descent with momentum; a fifth of the rows fits the temperature."""
    rng = np.random.default_rng(seed)
    features = features.astype(np.float64)
    mean, scale = (features.mean(axis=0), features.std(axis=0) + 1e-3) if len(features) else (np.zeros(FEATURES), np.ones(FEATURES))
    model = QualityModel(
        vectors, mean, scale, (rng.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, hidden)), np.zeros(hidden)), (rng.normal(0, 0.1, (hidden, 2)), np.zeros(2))
    )
    held = rng.random(len(labels)) < 0.2
    learn = np.flatnonzero(~held)
    x = (features - mean) / scale
    params = [*model.first, *model.second]
    speed = [np.zeros_like(p) for p in params]
    for epoch in range(epochs):
        step = 0.05 * (1 - epoch / epochs)
        order = rng.permutation(learn)
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            raw = x[rows] @ params[0] + params[1]
            mid = np.maximum(raw, 0)
            error = softmax(mid @ params[2] + params[3])
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            back = error @ params[2].T * (raw > 0)
            for p, v, g in zip(params, speed, (x[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), mid.T @ error, error.sum(axis=0)), strict=True):
                v *= 0.9
                v -= step * g
                p += v
    model.temperature = fit_temperature(model.logits(features[held]), labels[held]) if held.any() else 1.0
    return model


def _featured(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                rows = document_features(data, offsets, vectors)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * FEATURES)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["label", "features"]
                )

    return run


def fit_quality(
    docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality"
) -> QualityModel:
    """Word vectors from all texts; the network from at most about ``rows`` labelled rows, chosen by a hash, never held-out ones."""
    vectors = word_vectors(docs, text)
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(label_id))).select(F.col(label_id).cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    share = min(1.0, rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1_000_000)) < share * 1_000_000).limit(2 * rows)
    sample = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")  # at most 2 * rows rows
    found = sample.select("label", "_text").mapInArrow(_featured(vectors), "label int, features array<float>").limit(4 * rows).toPandas()
    features = np.stack(found["features"]) if len(found) else np.zeros((0, FEATURES), np.float32)
    order = np.lexsort((*features.T, found["label"].to_numpy()))  # the order of rows that come from tasks is not fixed
    return train(vectors, features[order], found["label"].to_numpy(np.int64)[order])


def quality_scorer(model: QualityModel):
    """Id and score for batches of ids and texts, their rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(1)):
                score = model.scores(document_features(data, offsets, model.vectors))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """``doc_id, score, predicted`` of every row; whole texts, no shuffle.

    ``score`` is the calibrated probability of good quality.  A null, empty or wordless text is scored by
    its zero features like any other.  Repeated rows are scored each, texts of any length whole.
    """
    plain = texts(docs, doc_id, text)
    return plain.mapInArrow(quality_scorer(model), "doc_id long, score double").withColumn("predicted", (F.col("score") >= least).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
