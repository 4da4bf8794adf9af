"""Exact batches, ledgers, checkpoints, background runs and networks on tables."""

import math
import threading
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloister.operators.layers import Embedding, LayerNorm, Linear, MeanPool, Network, conv, score_errors
from cloister.operators.learning import SGD, Adam, Cancelled, Checkpoint, Checkpoints, Dataset, Learner, Model, Registry, TrainConfig, gradient_sum
from cloister.operators.permute import Permutation
from cloister.operators.privacy import BudgetExceeded, BudgetLedger, PrivacyContext
from cloister.sources.commits import Journal, children, commit_bytes, read_bytes


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.integers(0, 1000))
def test_permutation_is_a_bijection(n, key):
    p = Permutation.of(n, key)
    assert sorted(p(np.arange(n)).tolist()) == list(range(n))


def test_permutation_of_many_and_column(spark):
    p = Permutation.of(1_000_003, "a", 1)
    found = p(np.arange(1_000_003))
    assert len(np.unique(found)) == 1_000_003 and found.max() == 1_000_002
    assert abs(np.corrcoef(np.arange(1_000_003), found)[0, 1]) < 0.01
    assert not np.array_equal(found[:50], Permutation.of(1_000_003, "a", 2)(np.arange(50)))
    for n in (1, 2, 3, 10, 101, 5000, 10**12):
        q = Permutation.of(n, 7)
        rows = np.unique(np.linspace(0, n - 1, 200).astype(np.int64))
        df = spark.createDataFrame([(int(i),) for i in rows], "i long")
        assert [r["p"] for r in df.select("i", q.column(F.col("i")).alias("p")).orderBy("i").collect()] == q(rows).tolist()


def test_commits_and_journals(spark, tmp_path):
    folder = f"file://{tmp_path}/j"
    assert read_bytes(spark, f"{folder}/x") is None and children(spark, folder) == []
    assert commit_bytes(spark, f"{folder}/x", b"\x00\xff") and not commit_bytes(spark, f"{folder}/x", b"other")
    assert read_bytes(spark, f"{folder}/x") == b"\x00\xff" and children(spark, folder) == ["x"]
    one, two = Journal(spark, f"{folder}/log"), Journal(spark, f"{folder}/log")
    assert one.last() == (0, None) and one.append({"a": 1}, 0) and not two.append({"a": 2}, 0)
    assert two.last() == (1, {"a": 1}) and two.add({"a": 3}) == 2 and one.last() == (2, {"a": 3})
    short = Journal(spark, f"{folder}/short", keep=2)
    slow = Journal(spark, f"{folder}/short", keep=2)
    short.add({"n": 1})
    assert slow.last() == (1, {"n": 1})
    for n in range(2, 9):
        short.add({"n": n})
    assert children(spark, f"{folder}/short") == ["0000000007.json", "0000000008.json"]
    assert slow.last() == (8, {"n": 8})  # what it knew last is gone


def test_two_writers_never_exceed_the_limit(spark, tmp_path):
    folder, granted, lock = f"file://{tmp_path}/budget", [], threading.Lock()

    def spender(k):
        context = PrivacyContext(1.0, 10, ledger=BudgetLedger(spark, folder))
        for _ in range(20):
            try:
                context.spend(0.0625)
            except BudgetExceeded:
                return
            with lock:
                granted.append(k)

    threads = [threading.Thread(target=spender, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(granted) == 15  # the sixteenth would reach the limit
    again = PrivacyContext(1.0, 10, ledger=BudgetLedger(spark, folder))
    assert again.spent == pytest.approx(15 / 16) and not again.poisoned
    with pytest.raises(BudgetExceeded):
        again.spend(math.inf)


def test_a_crash_after_spending_keeps_it_spent(spark, tmp_path):
    store = f"file://{tmp_path}/registry"
    first = Registry(spark, store)
    first.send_dataset("d", line(spark, 5.0))
    first.datasets["d"].context.spend(1.5)  # and the process ends here, before anything is released
    again = Registry(spark, store).datasets["d"].context
    assert (again.limit, again.spent, again.n) == (5.0, 1.5, 200)
    again.spend(3.0)
    with pytest.raises(BudgetExceeded):
        first.datasets["d"].context.spend(1.0)
    free = Registry(spark, store)
    free.send_dataset("f", line(spark, None))
    free.datasets["f"].context.spend(math.inf)
    assert Registry(spark, store).datasets["f"].context.poisoned


def line(spark, limit):
    rows = [(i, i / 200, 2 * i / 200) for i in range(200)]
    return Dataset.build(spark.createDataFrame(rows, "id long, x double, y double"), ["x"], "y", limit, F.col("id"))


@pytest.mark.parametrize("optimizer", [lambda: SGD(0.3, 0.9, nesterov=True), lambda: Adam(0.1, amsgrad=True)])
def test_killed_and_resumed_is_uninterrupted(spark, tmp_path, optimizer):
    whole = Learner(Model.zeros(1), line(spark, None), optimizer(), 40, seed=5)
    whole.fit(2, None)
    kept, steps = Checkpoints(spark, f"file://{tmp_path}/c"), []

    def kill(epoch, step, of):
        steps.append((epoch, step, of))
        if step == 8:
            raise KeyboardInterrupt

    first = Learner(Model.zeros(1), line(spark, None), optimizer(), 40, seed=5)
    with pytest.raises(KeyboardInterrupt):
        first.fit(2, None, per_n_steps_checkpoint=3, keep=kept, progress=kill)
    assert kept.numbers() == [3, 6] and steps[-1] == (1, 8, 10)
    second = Learner(Model.zeros(1), line(spark, None), SGD(9.0), 40, seed=77)
    second.fit(2, None, per_n_steps_checkpoint=3, resume=True, keep=kept)
    assert np.allclose(second.model.weights, whole.model.weights, atol=1e-12) and second.steps == 10 and kept.numbers() == [3, 6, 9]
    done = Learner(Model.zeros(1), line(spark, None), optimizer(), 40)
    done.fit(1, None, resume=True, keep=kept)  # nothing is left of a shorter training
    assert done.steps == 9


def test_checkpoint_round_trip():
    adam = Adam(0.2, amsgrad=True)
    w = adam.step(np.ones((2, 3)), np.arange(6.0).reshape(2, 3))
    found = Checkpoint.from_bytes(Checkpoint(1, 2, 3, 4, w, adam).to_bytes())
    assert (found.epoch, found.batch, found.steps, found.seed) == (1, 2, 3, 4) and np.array_equal(found.weights, w)
    assert np.array_equal(found.optimizer.step(w, w), adam.step(w, w))


def test_runs_in_the_background(spark, tmp_path):
    store = f"file://{tmp_path}/runs"
    registry = Registry(spark, store)
    registry.send_dataset("d", line(spark, None))
    registry.send_model("m", Model.zeros(1))
    run = registry.train(TrainConfig("m", "d", 6, None, 100, optimizer="SGD", options={"lr": 0.3, "momentum": 0.9}, seed=1))
    state = registry.wait(run)
    assert (state["status"], state["step"]) == ("ok", 12) and registry.available()["runs"] == [run]
    expected = Learner(Model.zeros(1), line(spark, None), SGD(0.3, 0.9), 100, seed=1)
    expected.fit(6, None)
    assert np.allclose(Registry(spark, store).fetch_model("m").weights, expected.model.weights)
    tested = registry.wait(registry.test("m", "d", "l2"))
    assert tested["value"] == pytest.approx(expected.test(line(spark, None), "l2")[0])
    # Cancelled, by another session, and resumed.
    registry.send_model("n", Model.zeros(1))
    run = registry.train(TrainConfig("n", "d", 6, None, 100, optimizer="SGD", options={"lr": 0.3, "momentum": 0.9}, seed=1))
    while registry.poll(run).get("step", 0) < 3:
        time.sleep(0.05)
    Registry(spark, store).cancel(run)
    assert registry.wait(run)["status"] == "cancelled"
    registry.threads[run].join()
    assert not np.allclose(registry.fetch_model("n").weights, expected.model.weights)
    other = Registry(spark, store)
    assert other.poll(run)["status"] == "cancelled"
    assert other.wait(other.train(None, run))["status"] == "ok"
    assert np.allclose(other.fetch_model("n").weights, expected.model.weights)
    # A failing run says why; one that says nothing is timed out.
    state = registry.wait(registry.train(TrainConfig("m", "d", 1, 5.0, optimizer="SGD", options={"lr": "x"})))
    assert state["status"] == "error" and "Error" in state["message"]
    Journal(spark, f"{store}/runs/silent/state").add({"status": "running"})
    with pytest.raises(TimeoutError):
        registry.wait("silent", timeout=0.3, delay=0.05)
    with pytest.raises(KeyError):
        registry.poll("none")
    with pytest.raises(ValueError, match="store"):
        Registry().poll("x")


def test_cancelled_run_is_noted(spark):
    def stop(*_):
        raise Cancelled("stop")

    learner = Learner(Model.zeros(1), line(spark, None), SGD(0.1), 50)
    with pytest.raises(Cancelled):
        learner.fit(1, None, progress=stop)
    assert learner.runs[0].status == "cancelled"


def sequences(spark, limit=None):
    rng = np.random.default_rng(2)
    rows = [(i, [int(t) for t in rng.integers(0, 6, rng.integers(0, 7)) + 6 * (i % 3)], i % 3) for i in range(90)]
    return rows, Dataset.build(spark.createDataFrame([*rows, (1000, None, 1), (1001, [None], 1)], "id long, tokens array<int>, y int"), ["tokens"], "y", limit, F.col("id"))


@pytest.mark.parametrize("layers", [lambda: [Embedding(18, 4), LayerNorm(4), MeanPool(), Linear(4, 3)], lambda: [Embedding(18, 4), *conv(4, 6, 3, padding=1), MeanPool(), Linear(6, 3)]])
def test_networks_on_tables_as_in_plain_numpy(spark, layers):
    """Trained by Spark jobs, a network has the weights that one sample after the other gives in numpy."""
    rows, data = sequences(spark)
    assert data.n == 90
    bound = 0.5
    net, plain = Network(layers(), seed=4), Network(layers(), seed=4)
    total, n = gradient_sum(data.df, net, bound)
    each = [plain.clipped_gradients([x], np.array([y]), None)[0] for _, x, y in rows]
    expected = sum(g * min(1, bound / (np.linalg.norm(g) + 1e-6)) for g in each)
    assert n == 90 and np.allclose(total, expected)
    learner = Learner(net, data, SGD(0.5, 0.9), 90)
    learner.fit(3, None)
    optimizer = SGD(0.5, 0.9)
    for _ in range(3):
        g = sum(plain.clipped_gradients([x], np.array([y]), None)[0] for _, x, y in rows)
        plain.weights = optimizer.step(plain.weights, g / 90)
    assert np.allclose(net.weights, plain.weights)
    assert learner.test(data, "accuracy")[0] == pytest.approx(np.mean([net.scores([x]).argmax() == y for _, x, y in rows]))


def test_private_network_learns_and_pays(spark):
    _, data = sequences(spark, 2e5)
    learner = Learner(Network([Embedding(18, 4), MeanPool(), Linear(4, 3)], seed=1), data, Adam(0.1), 30, seed=3)
    learner.fit(6, 1e5)
    assert learner.test(data, "accuracy", 100.0)[0] > 0.8 and 0 < data.context.spent < 2e5
    assert score_errors(np.array([[1000.0, 0.0]]), np.array([0.0]), "cross_entropy")[0, 0] == pytest.approx(0)


def test_tensors_make_a_dataset(spark):
    from cloister.operators.arrays import to_array

    df = spark.createDataFrame([(i, [float(i), 1.0], [2.0 * i, 0.0]) for i in range(9)], "k int, a array<double>, b array<double>")
    order = [F.col("a")[0]]
    pair = to_array(df.select("a", "b"), order).to_tensor()
    flat = to_array(df.select(F.col("a")[0].alias("a")), [F.col("a")]).to_tensor()
    assert (pair.dtype, pair.shape) == ("double", (9, 2, 2)) and repr(flat) == "Tensor(dtype=double, shape=(9, 1))" and flat.to("float").dtype == "float"
    assert not [n for n in vars(type(pair)) if n in ("df", "collect", "fetch")]
    data = Dataset.of_tensors([pair, flat], flat.to("float"), 3.0)
    assert (data.features, data.n, data.context.limit) == (5, 9, 3.0)
    assert {r["index"]: (r["x"], r["y"]) for r in data.df.collect()} == {i: ([i, 1.0, 2.0 * i, 0.0, i], i) for i in range(9)}
    short = to_array(df.limit(3).select(F.col("a")[0].alias("a")), [F.col("a")]).to_tensor()
    for inputs, label, words in (([short], flat, "heights"), ([flat], pair, "one number")):
        with pytest.raises(ValueError, match=words):
            Dataset.of_tensors(inputs, label, None)
    holes = to_array(df.select(F.when(F.col("k") > 3, F.col("k")).cast("double").alias("a")), [F.col("a")]).to_tensor()
    with pytest.raises(ValueError, match="4 rows"):
        Dataset.of_tensors([holes], flat, None)


def test_small_batches_take_few_jobs(spark):
    """A job takes the steps of many small batches, in turn: the weights are those of one step after the other."""
    data = line(spark, None)
    spark.sparkContext.setJobGroup("small-batches", "steps")
    try:
        learner = Learner(Model.zeros(1), data, SGD(0.1, 0.9), 8, seed=6)
        learner.fit(1, None)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert learner.steps == 25 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("small-batches")) < 15
    w, optimizer, model = np.zeros((1, 2)), SGD(0.1, 0.9), Model.zeros(1)
    with data.batches(8, 0, 6) as batches:
        for rows in [b.collect() for b in batches]:
            model.weights = w
            g, _ = model.clipped_gradients([r["x"] for r in rows], np.array([r["y"] for r in rows]), None)
            w = optimizer.step(w, g.reshape(w.shape) / 8)
    assert np.allclose(learner.model.weights, w) and np.allclose(learner.optimizer.velocity, optimizer.velocity)


def test_budget_ends_between_small_batches(spark):
    """Steps that were paid for are taken, the others are not."""
    learner = Learner(Model.zeros(1), line(spark, 20.0), SGD(0.1), 2, seed=6)
    with pytest.raises(PermissionError):
        learner.fit(1, 30.0)
    assert 0 < learner.steps < 100 and learner.model.weights.any() and learner.dataset.context.spent < 20


def test_inputs_are_computed_once_and_every_task_deals_few_batches(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def tokens(i):
        seen.add(1)
        return [i % 5] * (i % 3 + 1)

    rows = spark.range(400, numPartitions=4).select(F.col("id"), tokens("id").alias("x"), (F.col("id") % 2).alias("y"))
    data = Dataset.build(rows, ["x"], "y", None, F.col("id"))
    assert data.n == 400 and seen.value == 400
    spread = Dataset(data.df.repartition(4), data.context, data.features)
    for size, files in ((100, 4), (4, 1)):  # 100 batches are shuffled to folders of a task each
        with spread.batches(size, 0, 1) as batches:
            found = [[b.count(), b.select(F.input_file_name()).distinct().count()] for b, _ in zip(batches, range(2), strict=False)]
        assert found == [[size, files]] * 2
    learner = Learner(Network([Embedding(5, 2), MeanPool(), Linear(2, 2)], seed=1), data)
    assert learner.tests(data, ["cross_entropy", "accuracy"]) == [learner.test(data, m) for m in ("cross_entropy", "accuracy")]
