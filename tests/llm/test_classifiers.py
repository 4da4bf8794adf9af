import random
import zlib

import numpy as np
import pytest

from cloister.llm import langid, quality
from cloister.llm.langid import fit_languages, identify_languages, subwords
from cloister.llm.quality import fit_quality, score_quality, word_vectors
from cloister.llm.queries import queries

SYLLABLES = {"xa": ["ba", "ko", "ri", "na", "tu"], "yb": ["éch", "ùl", "or", "énn", "ist"], "zc": ["ß", "sch", "ung", "ver", "äk"]}


def _held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _docs(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, _text(rng, lang, rng.randint(2, 60)), lang, "clash"))
    odd = [(n, None, "xa", "c"), (n + 1, "", None, "c"), (n + 2, "123 !!", "yb", "c"), (n + 3, _text(rng, "xa", 60_000), "xa", "c"), (0, rows[0][1], "xa", "c"), (None, _text(rng, "yb", 9), "yb", "c")]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string"), rows


def test_language_accuracy_and_edges(spark):
    docs, rows = _docs(spark)
    found = identify_languages(docs, fit_languages(docs)).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) + 6
    held = [(i, lang) for i, _, lang, _ in rows if _held(i)]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.99 * len(held)
    assert sum(got[i]["rejected"] for i, _ in held) <= 0.01 * len(held)
    for i in range(len(rows), len(rows) + 3):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[len(rows) + 3]["lang_pred"] == "xa" and got[None]["lang_pred"] == "yb"
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_ignores_held_out_labels(spark):
    docs, _ = _docs(spark)
    spoiled = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 'zz' ELSE lang END AS lang", "score")
    one, two = (fit_languages(d) for d in (docs, spoiled))
    assert one.languages == two.languages and np.array_equal(one.table, two.table)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert fit_languages(docs) is None
    assert identify_languages(docs, None).first()["lang_pred"] == "und"
    assert identify_languages(docs.limit(0), None).collect() == []


def test_subwords_do_not_depend_on_the_batch():
    texts = ["Hé llo", "", "a", "x-y 9z", "İstanbul ΑΣ", " lead"]
    buckets, owner = subwords(texts)
    for i, text in enumerate(texts):
        assert sorted(buckets[owner == i]) == sorted(subwords([text])[0])


def _quality_docs(spark, n=900, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "of", "and"]) if k % 3 == 0 else "".join(rng.choice(SYLLABLES["xa"]) for _ in range(3)) for k in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words) if good else " | ".join(words).upper(), "clash"))
        labels.append((i, int(good), 0))
    odd = [(n, None, "c"), (n + 1, "", "c"), (n + 2, "w " * 200_000, "c"), (0, rows[0][1], "c"), (None, "the ba", "c")]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_quality_accuracy_and_edges(spark):
    docs, labels, truth = _quality_docs(spark)
    found = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(found) == len(truth) + 5
    got = {r["doc_id"]: r for r in found}
    held = [(i, q) for i, q, _ in truth if _held(i)]
    assert sum(got[i]["predicted"] == q for i, q in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)


def test_quality_ignores_held_out_labels(spark):
    docs, labels, _ = _quality_docs(spark, 300)
    spoiled = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    one, two = (fit_quality(docs, x) for x in (labels, spoiled))
    assert np.array_equal(one.first[0], two.first[0]) and one.temperature == two.temperature


def test_quality_without_labels_or_documents(spark):
    docs, labels, _ = _quality_docs(spark, 50)
    model = fit_quality(docs, labels.limit(0))
    assert score_quality(docs, model).count() == 55
    assert score_quality(docs.limit(0), fit_quality(docs.limit(0), labels)).collect() == []


def test_word_vectors_against_brute_force(spark):
    texts = ["the cat, the dog", "a 12!! é", None, "the cat"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    total = np.zeros(quality.WORDS * quality.DIMENSIONS)
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        words = quality.quality_words(data, np.array([0, len(data)]))
        for i, h in enumerate(words.hashes.tolist()):
            for j in range(max(0, i - quality.REACH), min(len(words.hashes), i + quality.REACH + 1)):
                if i != j:
                    g = int(words.hashes[j])
                    for k in range(quality.SIGNS):
                        total[(h >> 51) * quality.DIMENSIONS + (g >> 8 * k & quality.DIMENSIONS - 1)] += 2 * (g >> 8 * k + 7 & 1) - 1
    total = total.reshape(quality.WORDS, -1)
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(word_vectors(docs), want, atol=1e-6)


@pytest.mark.parametrize(("name", "column"), [("op6_language_id", "lang_pred"), ("op4_quality", "predicted")])
def test_queries_on_small_table(spark, name, column):
    found = queries()[name](spark, "/root/testdata/sf0.001")
    assert column in found.columns and found.count() == 200
    assert {r["doc_id"]: r["held_out"] for r in found.collect()} == {i: _held(i) for i in range(200)}


def test_fit_sample_is_bounded(spark):
    rows = [(i, f"text {i % 700}" if i % 3 else "hot", "xa" if i % 2 else "yb") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.fit_sample(docs, rows=50)
    assert 20 <= sample.count() <= 200


def naive_grams(text):
    """Buckets of the 2-, 3- and 4-grams within words, a space at each end, by plain Python."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = []
    for word in (f" {w} " for w in words):
        for n in (2, 3, 4):
            for at in range(len(word) - n + 1):
                gram = word[at : at + n]
                if gram.strip() and not (n == 4 and " " in gram[1:-1]):
                    h = n * 40503
                    for c, m in zip(gram, (2654435761, 2246822519, 3266489917, 668265263), strict=False):
                        h = (h ^ ord(c)) * m % 2**32
                        h ^= h >> 15
                    out.append(h >> 32 - langid.BUCKET_BITS)
    return out


TEXTS = ["Hé llo", "a", "x-y 9z", "İstanbul ΑΣ", " lead", "the cat sat; on THE mat", "ba ko ri", "b", "中文 字"]


@pytest.mark.parametrize("text", TEXTS)
def test_subwords_against_brute_force(text):
    assert sorted(subwords([text])[0].tolist()) == sorted(naive_grams(text))


def test_language_scores_against_brute_force(spark):
    docs, rows = _docs(spark, 300)
    model = fit_languages(docs)
    texts = [t for _, t, _, _ in rows[:40]] + TEXTS
    got = identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        grams = naive_grams(texts[r["doc_id"]])
        logits = [sum(float(model.table[g, k]) for g in grams) / len(grams) + float(model.bias[k]) for k in range(len(model.languages))]
        odds = [np.exp(v - max(logits)) for v in logits]
        assert r["lang_pred"] == model.languages[int(np.argmax(odds))]
        assert abs(r["score"] - max(odds) / sum(odds)) < 1e-5
        rare = sum(float(model.known[g]) for g in grams) / len(grams) < model.least_known[len(grams).bit_length() - 1]
        assert r["rejected"] == (r["score"] < model.least or bool(rare))


def test_language_gradients_against_differences():
    rng = np.random.default_rng(4)
    embedding, weights, bias = rng.normal(size=(9, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    own, times = np.array([1, 4, 7]), np.array([2, 1, 5])

    def loss():
        mean = sum(t * embedding[i] for i, t in zip(own, times, strict=True)) / times.sum()
        z = mean @ weights + bias
        return float(np.log(np.exp(z).sum()) - z[2])

    found = langid.loss_gradients(embedding, weights, bias, own, times, 2)
    for values, gradient, rows in ((embedding, found[0], own), (weights, found[1], range(4)), (bias, found[2], range(3))):
        for at, row in enumerate(rows):
            for k in np.ndindex(values[row].shape):
                place = (row, *k)
                values[place] += 1e-6
                up = loss()
                values[place] -= 2e-6
                down = loss()
                values[place] += 1e-6
                assert abs((up - down) / 2e-6 - gradient[(at, *k)]) < 1e-6


def test_more_languages_than_rows(spark):
    rows = [(i, f"text {i} of its own kind", f"l{i % 40}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit_sample(docs, rows=50, total=40).count() <= 80
    assert len(fit_languages(docs).languages) == 40


def _naive_quality_words(text):
    kind = lambda b: 0 if b <= 32 else 1 if chr(b).isalpha() and b < 128 or b >= 128 else 2 if chr(b).isdigit() else 3
    out, last = [], 0
    for b in (text or "").encode():
        if kind(b) and kind(b) == last:
            out[-1] += bytes([b])
        elif kind(b):
            out.append(bytes([b]))
        last = kind(b)
    return out


def test_quality_features_and_network_against_brute_force():
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(quality.WORDS, quality.DIMENSIONS)).astype(np.float32)
    texts = ["the cat, the dog 12!!", "", "é", "a b c d e f g", "x"]
    labels = rng.integers(0, 2, 200)
    model = quality.train(vectors, rng.normal(size=(200, quality.FEATURES)).astype(np.float32), labels, epochs=3)
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        got = quality.document_features(data, np.array([0, len(data)]), vectors)[0]
        words = _naive_quality_words(text)
        one = lambda w: int(quality.quality_words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hashes[0] >> np.uint64(51))
        v = [[float(x) for x in vectors[one(w)]] for w in words]
        n = len(v)
        want = np.zeros(quality.FEATURES)
        if n:
            for k in range(quality.DIMENSIONS):
                column = [x[k] for x in v]
                mean = sum(column) / n
                want[k], want[quality.DIMENSIONS + k] = mean, (sum((c - mean) ** 2 for c in column) / n) ** 0.5
            for reach in range(1, quality.REACH + 1):
                want[2 * quality.DIMENSIONS + reach - 1] = sum(sum(a * b for a, b in zip(v[i], v[i + reach], strict=True)) for i in range(n - reach)) / max(n - reach, 1)
            want[-1] = np.log(1 + n) / 10
        assert np.allclose(got, want, atol=1e-3)
        x = [(float(g) - m) / s for g, m, s in zip(got, model.mean, model.scale, strict=True)]
        hidden = [max(0.0, sum(a * w for a, w in zip(x, model.first[0][:, j], strict=True)) + model.first[1][j]) for j in range(len(model.first[1]))]
        z = [sum(h * w for h, w in zip(hidden, model.second[0][:, c], strict=True)) + model.second[1][c] for c in (0, 1)]
        assert abs(model.scores(got[None])[0] - 1 / (1 + np.exp((z[0] - z[1]) / model.temperature))) < 1e-6


def test_temperature_is_the_best_of_its_range():
    rng = np.random.default_rng(7)
    logits = rng.normal(size=(500, 2)) * 4
    labels = (rng.random(500) < 1 / (1 + np.exp((logits[:, 0] - logits[:, 1]) / 3))).astype(int)
    loss = lambda t: float(np.mean([np.log(np.exp(z / t).sum()) - z[k] / t for z, k in zip(logits, labels, strict=True)]))
    found = quality.fit_temperature(logits, labels)
    assert all(loss(found) <= loss(t) + 1e-3 for t in np.linspace(0.2, 9, 60))
    assert 2 < found < 5
