"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the 2-, 3- and 4-grams of letters within words, word ends included, lower-cased
and hashed into a fixed number of buckets.  A text is the mean of its subwords' embeddings; a linear softmax over that
mean is trained, embeddings included, by stochastic gradient descent in numpy on a bounded sample of
labelled rows, of which the driver gets counts of hashed subwords, not texts.  Scores are calibrated by a temperature, and texts below a calibrated score are rejected.
A score only compares the learned languages, so a text is also rejected if its subwords are rarer than those of clean
texts of its length: each counts with its log frequency in the language that uses it most.
Since averaging and the last layer are both linear, scoring needs one small table of bucket logits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibrate import fit_temperature, held_out, softmax
from .common import BROADCAST_IDS, materialise, read_table, texts as text_rows

UNKNOWN = "und"
BUCKET_BITS = 15
DIMENSIONS = 16

#: Bounds of the fitted sample, in expectation: rows of a language, rows of all languages, and bytes of their subword counts.
#: Whole texts are taken, whatever their length, and languages are not limited.
FIT_ROWS, FIT_TOTAL, FIT_BYTES = 600, 12_000, 256 << 20

#: Share of correctly identified calibration texts (whole texts, short runs and mixtures of two languages, not learned from) that
#: the least score rejects, and of runs of words that the bounds of how rare subwords may be reject.
CLEAN_REJECTED = 0.0005

#: Runs of so many words of each fitted text, and fewest runs of a length, that calibrate how rare subwords may be.
RUN_WORDS, LEAST_RUNS = (1, 2, 4, 8, 16, 32), 100

_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
_CHARS = 1 << 18


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_letters: list[np.ndarray] = []


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, text of each subword) of the texts, in order of length, then place."""
    if not _letters:
        _letters.append(letter_table())
    codes = [np.frombuffer((t.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    chars = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    letter = _letters[0][chars]
    keep = letter | np.concatenate(([False], letter[:-1]))  # a run of other characters becomes one space
    chars = np.where(letter, chars, 0x20)[keep].astype(np.uint32)
    chars = np.concatenate((np.array([0x20], np.uint32), chars))  # a space before the first word
    owner, inside = np.concatenate((owner[keep][:1], owner[keep])), chars != 0x20
    buckets, owners = [], []
    for n in (2, 3, 4):
        size = len(chars) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n * 40503, np.uint32)
        for j in range(n):
            h = (h ^ chars[j : j + size]) * _MULTIPLIERS[j]
            h ^= h >> np.uint32(15)
        within = inside[1 : 1 + size].copy() if n > 2 else inside[:size] | inside[1 : 1 + size]
        if n == 4:
            within &= inside[2 : 2 + size]
        # a gram that starts at the space before a word belongs to that word's text
        buckets.append((h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)[within])
        owners.append(owner[1 : 1 + size][within])
    return np.concatenate(buckets) if buckets else np.empty(0, np.int32), np.concatenate(owners) if owners else np.empty(0, np.int64)


@dataclass
class LanguageModel:
    """``table[b]`` holds the calibrated logits that bucket b adds to the mean."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    least: float  # texts that score lower are rejected
    known: np.ndarray  # log frequency of each bucket in the language that uses it most
    least_known: np.ndarray  # texts of 2^i subwords or more whose mean of ``known`` is below value i are rejected

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, number of subwords, whether these are too rare for the learned languages) of each text."""
        buckets, owner = subwords(texts)
        n = np.bincount(owner, minlength=len(texts))
        logits = np.stack([np.bincount(owner, self.table[buckets, k], len(texts)) for k in range(len(self.languages))], axis=1)
        known = np.bincount(owner, self.known[buckets], len(texts)) / np.maximum(n, 1)
        return softmax(logits / np.maximum(n, 1)[:, None] + self.bias), n, known < self.least_known[_size(n)]


def _size(n: np.ndarray) -> np.ndarray:
    """The power of two of each number of subwords."""
    return np.log2(np.maximum(n, 1)).astype(int)


@dataclass
class FitText:
    """A text to learn from: its distinct buckets, how often each occurs, and the buckets of some runs of its words."""

    own: np.ndarray
    times: np.ndarray
    runs: list[np.ndarray]


def fit_text(text: str, seed: int) -> FitText:
    rng, words = np.random.default_rng(seed), text.split()
    own, times = np.unique(subwords([text])[0], return_counts=True)
    starts = [int(rng.integers(max(1, len(words) - n + 1))) for n in RUN_WORDS]
    runs = [subwords([" ".join(words[at : at + n])])[0] for at, n in zip(starts, RUN_WORDS, strict=True)]
    return FitText(own, times, [r for r in runs if len(r)])


def familiarity(texts: list[FitText], target: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """``known`` and ``least_known`` of a model.  The bound of each length is the low quantile of runs of words of the texts,
    each judged by the counts of all texts but its own, so that no run vouches for itself."""
    buckets = 1 << BUCKET_BITS
    counts = np.zeros((languages, buckets), np.int64)
    for t, k in zip(texts, target, strict=True):
        counts[k, t.own] += t.times
    totals = counts.sum(axis=1)
    logs = np.log((counts + 1) / (totals + buckets)[:, None]).astype(np.float32)
    best, at = logs.max(axis=0), logs.argmax(axis=0)
    second = np.full(buckets, -np.inf, np.float32)
    for k in range(languages):
        second = np.where(at == k, second, np.maximum(second, logs[k]))
    found, value = [[] for _ in range(64)], np.zeros(buckets, np.float32)
    for t, k in zip(texts, target, strict=True):
        rest = np.log((counts[k, t.own] - t.times + 1) / (totals[k] - t.times.sum() + buckets))
        value[t.own] = np.maximum(rest, np.where(at[t.own] == k, second[t.own], best[t.own]))
        for run in t.runs:
            found[int(_size(np.array(len(run))))].append(float(value[run].mean()))
    least = np.full(64, -np.inf)
    for i, values in enumerate(found):
        least[i] = np.quantile(values, CLEAN_REJECTED) if len(values) >= LEAST_RUNS else -np.inf
    seen = np.flatnonzero(np.isfinite(least))
    if len(seen):
        least[seen[-1] + 1 :] = least[seen[-1]]  # longer ones as the longest run: kinds of text differ by as much, however long they are
    return best, np.minimum.accumulate(least[::-1])[::-1]  # shorter texts are never judged more strictly


def loss_gradients(embedding: np.ndarray, weights: np.ndarray, bias: np.ndarray, own: np.ndarray, times: np.ndarray, target: int):
    """Gradients of the log loss of one text by its buckets' embeddings, the weights and the bias."""
    share = times / times.sum()
    mean = share @ embedding[own]
    error = softmax((mean @ weights + bias)[None])[0]
    error[target] -= 1
    return np.outer(share, weights @ error), np.outer(mean, error), error


def train(texts: list[FitText], labels: list[str], epochs: int = 6, rate: float = 0.8, seed: int = 5) -> LanguageModel | None:
    """Fit on whole texts and, so that short texts are learned too, on short runs of their subwords."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    place = {name: k for k, name in enumerate(languages)}
    target = np.array([place[x] for x in labels])
    held = rng.random(len(texts)) < 0.2
    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(texts))
    embedding = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, done = epochs * len(learn), 0

    def piece(t: FitText) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(t.times)
        if rng.random() < 0.4 or not len(ends) or ends[-1] < 12:
            return t.own, t.times
        drawn = np.searchsorted(ends, rng.integers(ends[-1], size=int(rng.integers(6, 80))), side="right")
        at, times = np.unique(drawn, return_counts=True)
        return t.own[at], times

    for _ in range(epochs):
        for i in rng.permutation(learn):
            own, times = piece(texts[i])
            step, done = rate * (1 - done / steps), done + 1
            if not len(own):
                continue
            by_embedding, by_weights, by_bias = loss_gradients(embedding, weights, bias, own, times, int(target[i]))
            weights -= step * by_weights
            bias -= step * 0.1 * by_bias
            embedding[own] -= step * min(int(times.sum()), 20) * by_embedding
    table = embedding @ weights
    held = np.flatnonzero(held) if held.any() else learn
    logits, truth = [], []
    for i in held:
        for own, times in ((texts[i].own, texts[i].times), piece(texts[i])):
            if len(own):
                logits.append(times @ table[own] / times.sum() + bias)
                truth.append(target[i])
    logits, truth = np.array(logits).reshape(-1, len(languages)), np.array(truth, int)
    temperature = fit_temperature(logits, truth)
    sure = softmax(logits / temperature)
    right = sure.max(axis=1)[sure.argmax(axis=1) == truth].tolist()
    for _ in range(4 if len(languages) > 1 else 0):  # texts that mix two languages are clean too
        for i, j in zip(held, rng.permutation(held), strict=True):
            (one, n), (two, m) = piece(texts[i]), piece(texts[j])
            if target[i] != target[j] and len(one) and len(two):
                mixed = (n @ table[one] / n.sum() + m @ table[two] / m.sum()) / 2 + bias
                chances = softmax(mixed[None] / temperature)[0]
                if chances.argmax() in (target[i], target[j]):
                    right.append(float(chances.max()))
    least = float(np.quantile(right, CLEAN_REJECTED)) if right else 0.0
    return LanguageModel(languages, (table / temperature).astype(np.float32), bias / temperature, least, *familiarity(texts, target, len(languages)))


def fit_sample(docs: DataFrame, rows: int = FIT_ROWS, total: int = FIT_TOTAL, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, text, h``: about ``rows`` distinct texts of each language, of all languages about ``total`` and ``FIT_BYTES``, chosen
    by a hash of the text; never held-out rows."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    size = F.avg(F.least(F.length("text") * 3, F.lit(1 << BUCKET_BITS)) * 8)  # bytes of a text's counts
    found = materialise(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), size.alias("size")), "languages")
    languages = found.count()
    if not languages:
        return known.limit(0)
    share = F.least(F.lit(1.0), min(rows, total / languages) / F.col("n"), FIT_BYTES / languages / F.greatest(F.col("n") * F.col("size"), F.lit(1.0)))
    shares = found.select("lang", share.alias("share"))
    chosen = known.join(F.broadcast(shares) if languages <= BROADCAST_IDS else shares, "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    return chosen.select("lang", "text", "h").dropDuplicates(["lang", "h"]).limit(2 * total)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fit_text(text.as_py(), h & 0xFFFFFFFF) for text, h in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
        packed = [(t.own.astype("<u2").tobytes(), t.times.astype("<u4").tobytes(), [r.astype("<u2").tobytes() for r in t.runs]) for t in found]
        columns = [pa.array([p[i] for p in packed], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.list_(pa.binary())))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["lang", "h", "own", "times", "runs"])


def fit_languages(docs: DataFrame, **columns: str) -> LanguageModel | None:
    counted = fit_sample(docs, **columns).mapInArrow(_counted, "lang string, h long, own binary, times binary, runs array<binary>")
    rows = sorted(counted.toLocalIterator(), key=lambda r: (r["lang"], r["h"]))  # bounded by FIT_TOTAL and FIT_BYTES
    buckets = lambda data: np.frombuffer(data, "<u2")
    texts = [FitText(buckets(r["own"]), np.frombuffer(r["times"], "<u4").astype(np.int64), [buckets(x) for x in r["runs"]]) for r in rows]
    return train(texts, [r["lang"] for r in rows])


def language_scorer(model: LanguageModel | None):
    """The columns of ``identify_languages`` for batches of ids and texts, their rows in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["text"].str.len().fillna(0).to_numpy(np.int64)
            start = 0
            while start < len(batch):
                end = max(start + 1, start + int(np.searchsorted(np.cumsum(lengths[start:]), _CHARS, side="right")))
                part = batch.iloc[start:end]
                texts = ["" if t is None else t for t in part["text"]]
                language, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                rejected = np.ones(len(texts), bool)
                if model is not None:
                    p, n, foreign = model.scores(texts)
                    has = n > 0
                    language[has] = np.array(model.languages, object)[p.argmax(axis=1)][has]
                    score[has] = p.max(axis=1)[has]
                    rejected = ~has | (score < model.least) | foreign
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": language, "score": score, "rejected": rejected})
                start = end

    return run


def identify_languages(docs: DataFrame, model: LanguageModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row; whole texts, no shuffle.

    A null text or one without letters is ``und`` with score 0 and rejected; so is every text if there
    was nothing to learn from.  Otherwise ``score`` is the calibrated probability of ``lang_pred``, and a text
    is rejected if it is below the model's bound, or if its subwords are too rare in all learned languages.  Equal scores go to the language first in order.
    """
    plain = text_rows(docs, doc_id, text)
    return plain.mapInPandas(language_scorer(model), "doc_id long, lang_pred string, score double, rejected boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
