import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cloister.functions.expr import col, count
from cloister.operators.arrays import MIXED, TokenizerConfig, encode, to_array, train_test_split
from cloister.operators.learning import SGD, Adam, Dataset, Learner, Model, Registry
from cloister.operators.privacy import BudgetExceeded, Guarded, PrivacyContext, noise, sigma
from cloister.streaming.windows import drain, read_files, sessions, windowed


def test_arrays(spark):
    df = spark.createDataFrame([(i, j, i * j) for i, j in zip(range(5), (2, 3, 5, 6, 7), strict=True)], "a long, b long, c long")
    a = to_array(df, [F.col("a")])
    assert a.shape == (5, 3) and a.dtype == "bigint"
    assert a.df.orderBy("row").first()["value"] == [0, 2, 0]
    train, test = train_test_split(a, test_size=0.2)
    assert (train.height, test.height) == (4, 1)
    mixed = train_test_split(a, a, train_size=0.7, shuffle=True, random_state=3)
    assert [m.height for m in mixed] == [3, 2, 3, 2]
    assert mixed[0].df.orderBy("row").collect() == mixed[2].df.orderBy("row").collect()
    assert sorted(r["value"][0] for m in mixed[:2] for r in m.df.collect()) == list(range(5))
    for sizes in ({"train_size": -1}, {"test_size": -0.1}):
        with pytest.raises(ValueError):
            train_test_split(a, **sizes)
    assert a.append(a).height == 10 and a.stack(a).shape == (5, 2, 3) and a.to("float").df.first()["value"][0] is not None
    assert a.shuffle(1).height == 5


def test_list_arrays_and_errors(spark):
    lists = spark.createDataFrame([([0, 1, 2, 3, 4], [2, 3, 5, 6, 7])], "a array<long>, b array<long>")
    assert to_array(lists, [F.size("a")]).shape == (1, 2, 5)
    for rows, schema in (([([1], [1.0])], "a array<long>, b array<double>"), ([(1, 1.0)], "a long, b double")):
        with pytest.raises(TypeError, match=MIXED):
            to_array(spark.createDataFrame(rows, schema), [F.col("a")])
    with pytest.raises(TypeError, match="tokenized"):
        to_array(spark.createDataFrame([("a",)], "a string"), [F.col("a")])
    with pytest.raises(ValueError):
        to_array(spark.createDataFrame([([1],), ([1, 2],)], "a array<long>"), [F.col("a")])


def test_tokens(spark):
    df = spark.createDataFrame([("two short words",), (None,), ("the cat sat on the mat and more",)], "words string")
    config = TokenizerConfig(public_tokenizers.path("byte_bpe_50k.json")).enable_padding(5)
    got = encode(df, config).collect()
    assert [None if r["words_ids"] is None else len(r["words_ids"]) for r in got] == [5, None, 5]
    assert got[0]["words_mask"] == [1, 1, 1, 0, 0] and got[2]["words_mask"] == [1] * 5
    assert len(encode(df, config.no_padding()).collect()[2]["words_ids"]) > 5
    assert len(encode(df, config.no_padding().enable_truncation(2)).collect()[2]["words_ids"]) == 2
    with pytest.raises(TypeError):
        encode(spark.range(2), config)


def test_budget():
    context = PrivacyContext(1.0, 100)
    assert context.delta == 1 / 1000
    context.spend(0.5)
    with pytest.raises(BudgetExceeded):
        context.spend(0.5)  # the limit itself is out of bounds
    context.spend(0.4)
    assert context.spent == pytest.approx(0.9)
    with pytest.raises(BudgetExceeded):
        Guarded(np.zeros(2), context, 1.0).release(None)
    free = PrivacyContext(None, 5)
    free.spend(math.inf)
    assert free.poisoned


def test_noise_has_its_deviation():
    draws = noise((20_000,), sigma(1.0, 1e-3, 2.0), np.random.default_rng(1))
    assert draws.std() == pytest.approx(2.0 * math.sqrt(2 * math.log(1250)), rel=0.03)


def test_sensitivity():
    c = PrivacyContext(None, 10)
    a, b = (Guarded(np.ones((4, 3)), c, None, frozenset([k])) for k in (0, 1))
    with pytest.raises(ValueError, match="clamp"):
        a.release(1.0)
    x, y = a.clamp(0, 2), b.clamp(-1, 2)
    assert x.linf == 2 and (x + y).linf == 3 and (x + x).linf == 4 and (x - y).linf == 3
    assert (x * -3).linf == 6 and (x / 2).linf == 1 and x.argmax().linf == 2 and x.sum().linf == 2
    assert (x + 1).linf == 2 and (x + x).batches is None and (x + x).sum().linf == 4 * 12


def _line(spark, limit):
    rows = [(i, i / 200, 2 * i / 200) for i in range(200)]
    return Dataset.build(spark.createDataFrame(rows, "id long, x double, y double"), ["x"], "y", limit, F.col("id"))


@pytest.mark.parametrize("optimizer", [SGD(0.3, 0.9), SGD(0.3, 0.9, nesterov=True), Adam(0.2), Adam(0.5, amsgrad=True)])
def test_line_is_found(spark, optimizer):
    data = _line(spark, None)
    learner = Learner(Model.zeros(1), data, optimizer, max_batch_size=100)
    run = learner.fit(nb_epochs=14, eps=None, per_n_epochs_checkpoint=7)
    assert run.status == "ok" and len(run.checkpoints) == 2
    assert learner.model.weights[0] == pytest.approx([2, 0], abs=0.35)
    assert learner.test(data, "l2")[0] < 0.05


def test_private_line_and_limit(spark):
    data = _line(spark, 8001.1)
    learner = Learner(Model.zeros(1), data, SGD(0.3, 0.9), max_batch_size=100, seed=2)
    learner.fit(nb_epochs=12, eps=4000.0)
    assert learner.model.weights[0][0] == pytest.approx(2, abs=0.8)
    assert 0 < data.context.spent < 8001
    poor = Learner(Model.zeros(1), _line(spark, 0.001), SGD(0.1))
    with pytest.raises(BudgetExceeded):
        poor.fit(nb_epochs=2, eps=5.0)
    assert poor.runs[0].status == "error"
    with pytest.raises(BudgetExceeded):
        Learner(Model.zeros(1), _line(spark, 10.0), SGD(0.1)).fit(nb_epochs=1, eps=None)


def test_classes_and_registry(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y), float(x + y > 0)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))]
    data = Dataset.build(spark.createDataFrame(rows, "id long, a double, b double, c double"), ["a", "b"], "c", None, F.col("id"))
    learner = Learner(Model.zeros(2, 2, "cross_entropy"), data, SGD(0.5, 0.9), max_batch_size=150)
    learner.fit(nb_epochs=5, eps=None)
    assert learner.test(data, "accuracy")[0] > 0.95
    registry = Registry()
    registry.send_model("m", learner.model)
    assert np.allclose(registry.fetch_model("m").weights, learner.model.weights)
    assert registry.available()["models"] == ["m"]
    registry.delete("m")
    assert registry.available()["models"] == []


def test_streams(spark, tmp_path):
    events = spark.range(600).selectExpr("timestamp_seconds(id * 60) AS ts", "id % 3 AS k", "1.0D AS v")
    folder = f"file://{tmp_path}/in"
    events.write.parquet(folder)
    stream = read_files(spark, folder, events.schema)
    drain(windowed(stream, "ts", "1h", col("v").sum().alias("s"), count().alias("n"), by=("k",)), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 27 and {r["n"] for r in got} == {20}  # nine closed hours of three keys
    drain(windowed(stream, "ts", "1h", count().alias("n"), least=61), f"{tmp_path}/out2", f"{tmp_path}/state2")
    assert spark.read.schema("ts timestamp, n long").parquet(f"{tmp_path}/out2").count() == 0
    batch = sessions(events.where("id % 100 < 10") if "id" in events.columns else events, "ts", "5m", count().alias("n"))
    assert batch.count() == 1


def test_noise_is_fresh(spark):
    """Trainings and tests with equal seeds differ in their noise, and so do those of one another."""
    found = []
    for _ in range(2):
        data = _line(spark, 100.0)
        learner = Learner(Model.zeros(1), data, SGD(0.1), max_batch_size=200, seed=1)
        learner.fit(nb_epochs=1, eps=5.0)
        found.append(tuple(learner.model.weights[0]))
    assert found[0][0] != found[1][0] and found[0][1] != found[1][1]
    context = PrivacyContext(10.0, 100)
    draws = [Guarded(np.zeros(1), context, 1.0).release(0.5)[0] for _ in range(2)]
    assert draws[0] != draws[1]
    seeded = [PrivacyContext(10.0, 100, rng=np.random.default_rng(3)) for _ in range(2)]
    assert len({float(Guarded(np.zeros(1), c, 1.0).release(0.5)[0]) for c in seeded}) == 1


def test_batches_are_exact(spark):
    data = _line(spark, None)
    with data.batches(30, 0, 7) as batches:
        parts = [{r["id"] for r in b.collect()} for b in batches]
    assert [len(p) for p in parts] == [30] * 6 and len(set().union(*parts)) == 180  # the last twenty rows of the permutation are in none
    with data.batches(30, 0, 7, start=4) as batches:
        assert [{r["id"] for r in b.collect()} for b in batches] == parts[4:]
    with data.batches(30, 1, 7) as batches:
        assert [{r["id"] for r in b.collect()} for b in batches] != parts


def test_released_column(spark):
    from cloister.operators.privacy import release_column

    df = spark.range(20_000).selectExpr("id", "0L AS n")
    context = PrivacyContext(1.0, 1000)
    row = release_column(df, "n", context, 2.0, 0.9).agg(F.stddev("n").alias("sd"), F.avg("n").alias("m")).first()
    assert row["sd"] == pytest.approx(sigma(0.9, context.delta, 2.0), rel=0.05) and abs(row["m"]) < 1
    with pytest.raises(BudgetExceeded):
        release_column(df, "n", context, 2.0, 0.5)
    with pytest.raises(BudgetExceeded):
        release_column(df, "n", context, 2.0, None)


def test_registry_is_found_again(spark, tmp_path):
    store = f"file://{tmp_path}/registry"
    first = Registry(spark, store)
    first.send_model("m", Model(np.array([[1.5, 2.0]])))
    first.send_dataset("d", _line(spark, 2.0))
    first.datasets["d"].context.spend(0.5)
    again = Registry(spark, store)
    assert again.available()["models"] == ["m"] and again.available()["datasets"] == ["d"]
    found = again.datasets["d"]
    assert (found.context.limit, found.context.spent, found.n, found.df.count()) == (2.0, 0.5, 200, 200)
    again.delete("d")
    again.delete("m")
    assert Registry(spark, store).available()["datasets"] == []


def test_long_texts_are_encoded_in_turn(spark):
    """However many rows an Arrow batch has, texts of a megabyte or so are encoded at once; nulls and padding stay in place."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from cloister.operators.arrays import TokenizerConfig, encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "one two " * 90_000, "three", None, "four five " * 70_000, "six", "seven " * 200_000, None]
    out = encode(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), TokenizerConfig(path, max_length=150_000).enable_padding(3, 7))
    assert "MapInArrow" in out._jdf.queryExecution().toString()  # an evaluated column would have all rows of a batch at once
    plain = Tokenizer.from_file(path)
    for t, r in zip(texts, out.collect(), strict=True):
        ids = None if t is None else plain.encode(t).ids[:150_000]
        assert r["text_ids"] == (None if t is None else ids + [7] * (3 - len(ids))) and r["text_mask"] == (None if t is None else [1] * len(ids) + [0] * (3 - len(ids)))
