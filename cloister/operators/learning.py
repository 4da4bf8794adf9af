"""Private training on tables: linear models and networks, exact batches, checkpoints that survive the driver, and runs in the background.

Samples are rows ``index, id, x, y``; ``x`` is an array of numbers.  Each step takes one batch; executors compute each sample's gradient,
clip it and add up, so only sums of the size of the model, of the parameters that a batch touches, reach the driver, where the noise is added.
"""

from __future__ import annotations

import contextlib
import copy
import io
import json
import math
import pickle
import secrets
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloister.operators.arrays import Tensor
from cloister.operators.layers import Network, score_errors, score_losses
from cloister.operators.ordered import row_index
from cloister.operators.permute import Permutation
from cloister.operators.privacy import BudgetLedger, Guarded, PrivacyContext, noise, sigma, step_cost, step_epsilon
from cloister.sources.commits import Journal, children, commit_bytes, read_bytes
from cloister.sources.scratch import materialise, remove_path, scratch_path

#: Folders that an epoch's batches are dealt to, at most; a step reads one of them.
BATCH_FOLDERS = 1000

#: An epoch of so many folders at most is dealt without a shuffle: each task writes its rows of every folder.
FEW_FOLDERS = 32

#: Batches of so many samples at most are a task's work at best: one task takes the steps of several, one after the other, over so many samples at most.
TASK_BATCH, RUN_SAMPLES = 2_000, 50_000


class Cancelled(RuntimeError):
    """A run was asked to stop."""


@dataclass
class Dataset:
    """``df`` has ``index`` (dense, from 0), ``id, x, y``; ``context`` is its budget."""

    df: DataFrame
    context: PrivacyContext
    features: int

    @staticmethod
    def build(df: DataFrame, inputs: list[str], label: str, limit: float | None, id_: Column | None = None) -> Dataset:
        """Inputs are numeric columns, or one column of arrays of numbers, such as tokens, whose length may differ.  Rows
        with a null input or label are left out.  Rows are numbered in order of ``id_``, which should tell them apart."""
        key = id_ if id_ is not None else F.monotonically_increasing_id()
        if len(inputs) == 1 and isinstance(df.schema[inputs[0]].dataType, T.ArrayType):
            x, features = F.col(f"`{inputs[0]}`").cast("array<double>"), 0
        else:
            x, features = F.array(*[F.col(f"`{c}`").cast("double") for c in inputs]), len(inputs)
            df = df.na.drop(subset=inputs)
        # Written before rows are left out and sorted, as each of these steps would compute the inputs anew.
        rows = materialise(df.select(key.cast("long").alias("id"), x.alias("x"), F.col(f"`{label}`").cast("double").alias("y")), "samples")
        rows = rows.where(~F.exists("x", lambda v: v.isNull())).na.drop()
        found = materialise(row_index(rows, [F.col("id")], "index"), "dataset")
        return Dataset(found, PrivacyContext(limit, found.count()), features)

    @staticmethod
    def of_tensors(inputs: list[Tensor], label: Tensor, limit: float | None) -> Dataset:
        """Samples of tensors of equal heights: a sample's input is the numbers of its row in each of ``inputs``, one after the other; ``label`` has one number
        a row.  Rows keep their numbers, so none may be without values."""
        tensors = [*inputs, label]
        if len({t.shape[0] for t in tensors}) > 1:
            raise ValueError(f"tensors of different heights: {', '.join(str(t.shape[0]) for t in tensors)}")
        if math.prod(label.shape[1:]) != 1:
            raise ValueError("a label is one number")
        rows, columns = None, []
        for k, t in enumerate(tensors):
            flat = F.col("value")
            for _ in t.shape[2:]:
                flat = F.flatten(flat)
            part = t._array.df.select("row", flat.cast("array<double>").alias(f"v{k}"))
            rows, columns = part if rows is None else rows.join(part, "row"), [*columns, F.col(f"v{k}")]
        found = rows.select(F.col("row").alias("index"), F.col("row").alias("id"), F.concat(*columns[:-1]).alias("x"), columns[-1][0].alias("y"))
        found = materialise(found, "dataset")
        missing = F.col("x").isNull() | F.exists("x", lambda v: v.isNull()) | F.col("y").isNull()
        n, empty = found.agg(F.count(F.lit(1)), F.count_if(missing)).first()
        if empty:
            raise ValueError(f"{empty} rows have no value in some tensor")
        return Dataset(found, PrivacyContext(limit, n), sum(math.prod(t.shape[1:]) for t in inputs))

    @property
    def n(self) -> int:
        return self.context.n

    def batch_count(self, size: int) -> int:
        """Batches of an epoch: those of exactly ``size`` samples."""
        return self.n // size if size else 0

    @contextlib.contextmanager
    def batches(self, size: int, epoch: int, seed: int, start: int = 0) -> Iterator[Iterator[DataFrame]]:
        """An epoch's batches from number ``start`` on, each of exactly ``size`` rows; the rows left over are in none.

        A keyed permutation of the row numbers says which batch a row is in, so an epoch's batches are the same whenever
        they are asked for.  One pass deals rows to a folder for each batch, so that a step reads its own rows only.
        """
        count = self.batch_count(size)
        if count == 1 and size == self.n:
            yield iter([self.df][start:])
            return
        with self._dealt(size, epoch, seed, start, 1) as part:
            yield (part(b, b + 1).drop("batch") for b in range(start, count))

    @contextlib.contextmanager
    def _dealt(self, size: int, epoch: int, seed: int, start: int, length: int) -> Iterator[Callable[[int, int], DataFrame]]:
        """An epoch's rows dealt to folders, one for ``length`` batches that follow each other; a function of a first batch and
        the one after the last, of the same folder, that gives their rows with the number of their ``batch``."""
        batch, count = F.call_function("div", Permutation.of(self.n, seed, epoch).column(F.col("index")), F.lit(size).cast("long")), self.batch_count(size)
        folder = F.call_function("div", F.col("batch"), F.lit(length).cast("long")) % BATCH_FOLDERS
        dealt = self.df.withColumn("batch", batch).where((F.col("batch") < count) & (F.col("batch") >= start)).withColumn("folder", folder)
        spark, path = self.df.sparkSession, scratch_path(self.df.sparkSession, "batches")
        if math.ceil(count / length) > FEW_FOLDERS:  # a task for each folder, or for so many rows of it
            dealt = dealt.repartition("folder", F.col("index") % math.ceil(size * length / RUN_SAMPLES))
        dealt.write.partitionBy("folder").parquet(path)
        try:
            table = spark.read.schema(dealt.schema).parquet(path)
            yield lambda a, b: table.where((F.col("folder") == a // length % BATCH_FOLDERS) & (F.col("batch") >= a) & (F.col("batch") < b)).drop("folder")
        finally:
            remove_path(spark, path)


@dataclass
class Model:
    """``weights`` (outputs, features + 1): linear regression for one output and loss "l2", softmax for several and "cross_entropy"."""

    weights: np.ndarray
    loss: str = "l2"

    @staticmethod
    def zeros(features: int, outputs: int = 1, loss: str = "l2") -> Model:
        return Model(np.zeros((outputs, features + 1)), loss)

    def _inputs(self, x) -> np.ndarray:
        x = np.stack([np.asarray(v, float) for v in x]) if len(x) else np.zeros((0, self.weights.shape[1] - 1))
        return np.hstack([x, np.ones((len(x), 1))])

    def scores(self, x) -> np.ndarray:
        return self._inputs(x) @ self.weights.T

    def losses(self, x, y: np.ndarray) -> np.ndarray:
        return score_losses(self.scores(x), y, self.loss)

    def clipped_gradients(self, x, y: np.ndarray, max_norm: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(sum of per-sample gradients, each scaled to norm ``max_norm`` at most, flat; which parameters are touched)."""
        inputs, errors = self._inputs(x), score_errors(self.scores(x), y, self.loss)
        if max_norm is not None:  # the gradient of a sample is the outer product of its error and its inputs
            norm = np.linalg.norm(errors, axis=1) * np.linalg.norm(inputs, axis=1)
            errors = errors * np.minimum(1, max_norm / (norm + 1e-6))[:, None]
        return (errors.T @ inputs).ravel(), np.full(self.weights.size, len(inputs) > 0)

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights.tolist(), "loss": self.loss})


def model_from_json(text: str) -> Model | Network:
    data = json.loads(text)
    return Network.from_json(text) if "layers" in data else Model(np.array(data["weights"]), data["loss"])


def gradient_sum(batch: DataFrame, model: Model | Network, max_norm: float | None) -> tuple[np.ndarray, int]:
    """(sum of per-sample gradients, each scaled to norm ``max_norm`` at most, in the shape of the weights; samples)."""
    size, shared = model.weights.size, batch.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total, touched, n = shared.value, np.zeros(size), np.zeros(size, bool), 0
        for part in parts:
            if len(part):
                g, at = own.clipped_gradients(part["x"].tolist(), part["y"].to_numpy(), max_norm)
                total, touched, n = total + g, touched | at, n + len(part)
        found = np.flatnonzero(touched)
        yield pd.DataFrame({"i": np.append(found, -1), "g": np.append(total[found], float(n))})  # the number of samples goes as -1

    sums = batch.select("x", "y").mapInPandas(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros(size + 1)
    out[sums["i"].to_numpy()] = sums["g"].to_numpy()
    shared.unpersist()
    return out[:-1].reshape(model.weights.shape), int(out[-1])


@dataclass
class SGD:
    lr: float = 0.1
    momentum: float = 0.0
    dampening: float = 0.0
    weight_decay: float = 0.0
    nesterov: bool = False
    velocity: np.ndarray | None = None

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.weight_decay * w
        if self.momentum:
            self.velocity = g if self.velocity is None else self.momentum * self.velocity + (1 - self.dampening) * g
            g = g + self.momentum * self.velocity if self.nesterov else self.velocity
        return w - self.lr * g


@dataclass
class Adam:
    lr: float = 0.001
    beta_1: float = 0.9
    beta_2: float = 0.999
    epsilon: float = 1e-8
    weight_decay: float = 0.0
    amsgrad: bool = False
    t: int = 0
    m: np.ndarray | None = None
    v: np.ndarray | None = None
    v_max: np.ndarray | None = None

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.weight_decay * w
        zero = np.zeros_like(w)
        self.t += 1
        self.m = self.beta_1 * (zero if self.m is None else self.m) + (1 - self.beta_1) * g
        self.v = self.beta_2 * (zero if self.v is None else self.v) + (1 - self.beta_2) * g * g
        v = self.v / (1 - self.beta_2**self.t)
        if self.amsgrad:
            self.v_max = v if self.v_max is None else np.maximum(self.v_max, v)
            v = self.v_max
        return w - self.lr * self.m / (1 - self.beta_1**self.t) / (np.sqrt(v) + self.epsilon)


OPTIMIZERS = {"SGD": SGD, "Adam": Adam}


def _in_turn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each batch, of tables that are sorted by ``batch``."""
    held: list[pd.DataFrame] = []
    for part in parts:
        for number, rows in part.groupby("batch", sort=True):
            if held and held[0]["batch"].iat[0] != number:
                yield pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held)


def run_steps(rows: DataFrame, model: Model | Network, optimizer: SGD | Adam, max_norm: float | None, std: float, rng: np.random.Generator) -> tuple[np.ndarray, SGD | Adam, int]:
    """(weights, optimiser, steps) after a step for each ``batch`` of the rows, in turn, in one task that holds one batch at a time.  Noise of deviation
    ``std`` is added to each sum before it is used.  Its seed is drawn from ``rng``, so a task that is tried again draws the same noise, not other noise on the same sums."""
    shared = rows.sparkSession.sparkContext.broadcast((model, optimizer, rng.integers(0, 2**63, 4).tolist()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, by = copy.deepcopy(shared.value[:2])  # a worker keeps what was broadcast
        done, draws = 0, np.random.default_rng(shared.value[2])
        for batch in _in_turn(parts):
            total, _ = own.clipped_gradients(batch["x"].tolist(), batch["y"].to_numpy(), max_norm)
            total = total.reshape(own.weights.shape)
            own.weights = by.step(own.weights, (total + noise(total.shape, std, draws)) / len(batch))
            done += 1
        if done:
            yield pd.DataFrame({"state": [pickle.dumps((own.weights, by, done))]})

    found = rows.select("batch", "index", "x", "y").coalesce(1).sortWithinPartitions("batch", "index").mapInPandas(run, "state binary").collect()  # one row
    shared.unpersist()
    return pickle.loads(found[0]["state"])


@dataclass
class Checkpoint:
    """Where a training stands before batch ``batch`` of epoch ``epoch``: weights, the optimiser's state, the steps done and the seed of the batches."""

    epoch: int
    batch: int
    steps: int
    seed: int
    weights: np.ndarray
    optimizer: SGD | Adam

    def to_bytes(self) -> bytes:
        state = {f"state_{k}": v for k, v in vars(self.optimizer).items() if isinstance(v, np.ndarray)}
        plain = {k: v for k, v in vars(self.optimizer).items() if not isinstance(v, np.ndarray)}
        about = {"epoch": self.epoch, "batch": self.batch, "steps": self.steps, "seed": self.seed, "optimizer": type(self.optimizer).__name__, "plain": plain}
        out = io.BytesIO()
        np.savez(out, about=np.array(json.dumps(about)), weights=self.weights, **state)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Checkpoint:
        with np.load(io.BytesIO(data), allow_pickle=False) as found:
            about = json.loads(str(found["about"]))
            state = {k.removeprefix("state_"): found[k] for k in found.files if k.startswith("state_")}
            optimizer = OPTIMIZERS[about["optimizer"]](**about["plain"] | state)
            return Checkpoint(about["epoch"], about["batch"], about["steps"], about["seed"], found["weights"], optimizer)


@dataclass
class Checkpoints:
    """Checkpoints in a folder, each committed as a whole under its number of steps."""

    spark: SparkSession
    folder: str

    def numbers(self) -> list[int]:
        return [int(n[:-4]) for n in children(self.spark, self.folder) if n.endswith(".npz")]

    def save(self, checkpoint: Checkpoint) -> None:
        """Two trainings that reach the same step from the same start have the same checkpoint (but for noise): the first stays."""
        commit_bytes(self.spark, f"{self.folder}/{checkpoint.steps:010d}.npz", checkpoint.to_bytes())

    def load(self, steps: int) -> Checkpoint:
        return Checkpoint.from_bytes(read_bytes(self.spark, f"{self.folder}/{steps:010d}.npz"))

    def last(self) -> Checkpoint | None:
        found = self.numbers()
        return self.load(found[-1]) if found else None


@dataclass
class Run:
    """State of a training: pending, ok, cancelled or error, and checkpoints of the weights."""

    status: str = "pending"
    losses: list[float] = field(default_factory=list)
    checkpoints: list[np.ndarray] = field(default_factory=list)
    message: str = ""


@dataclass
class Learner:
    model: Model | Network
    dataset: Dataset
    optimizer: SGD | Adam = field(default_factory=Adam)
    max_batch_size: int = 64
    max_grad_norm: float = 1.0
    metric_eps: float = 0.01
    seed: int = field(default_factory=lambda: secrets.randbits(62))  # of the batches; noise has no seed
    steps: int = 0
    runs: list[Run] = field(default_factory=list)

    def fit(
        self,
        nb_epochs: int,
        eps: float | None,
        batch_size: int | None = None,
        per_n_steps_checkpoint: int = 0,
        per_n_epochs_checkpoint: int = 0,
        resume: bool = False,
        keep: Checkpoints | None = None,
        progress: Callable[[int, int, int], None] = lambda epoch, step, of: None,
    ) -> Run:
        """Train with a total of ``eps`` (None: without privacy, which only an unlimited data set allows).

        With ``keep``, checkpoints are also committed there, each with all that the next step depends on, and a
        training with ``resume`` goes on from the last one as if it had not been interrupted.  Steps after the last
        checkpoint are done, and paid for, again, as their noise is drawn anew.  ``progress`` is told before each step and may raise ``Cancelled``.
        """
        run, context, first_epoch, first_batch = Run(), self.dataset.context, 0, 0
        self.runs.append(run)
        if not resume:
            self.steps = 0
        elif keep is not None and (found := keep.last()) is not None:
            self.model.weights, self.optimizer, self.steps, self.seed = found.weights, found.optimizer, found.steps, found.seed
            first_epoch, first_batch = found.epoch, found.batch
        size = min(batch_size or self.max_batch_size, max(self.dataset.n, 1))
        count, rate = self.dataset.batch_count(size), size / max(self.dataset.n, 1)
        own = None if eps is None else step_epsilon(eps, rate, nb_epochs)

        def checkpoint(epoch: int, batch: int) -> None:
            run.checkpoints.append(self.model.weights.copy())
            if keep is not None:
                keep.save(Checkpoint(epoch, batch, self.steps, self.seed, self.model.weights, self.optimizer))

        try:
            for epoch in range(first_epoch, nb_epochs):
                start = first_batch if epoch == first_epoch else 0
                if count > 1 and size <= TASK_BATCH:
                    self._short_steps(size, epoch, start, own, rate, per_n_steps_checkpoint, checkpoint, lambda k, e=epoch: progress(e, e * count + k, nb_epochs * count))
                    if per_n_epochs_checkpoint and (epoch + 1) % per_n_epochs_checkpoint == 0:
                        checkpoint(epoch + 1, 0)
                    continue
                with self.dataset.batches(size, epoch, self.seed, start) as batches:
                    for k, batch in enumerate(batches, start):
                        progress(epoch, epoch * count + k, nb_epochs * count)
                        self._step(batch, size, own, rate)
                        if per_n_steps_checkpoint and self.steps % per_n_steps_checkpoint == 0:
                            checkpoint(epoch, k + 1)
                if per_n_epochs_checkpoint and (epoch + 1) % per_n_epochs_checkpoint == 0:
                    checkpoint(epoch + 1, 0)
            if not run.checkpoints:
                checkpoint(nb_epochs, 0)
            run.status = "ok"
        except (PermissionError, Cancelled) as error:
            run.status, run.message = "cancelled" if isinstance(error, Cancelled) else "error", str(error)
            raise
        return run

    def _step(self, batch: DataFrame, size: int, eps: float | None, rate: float) -> None:
        context = self.dataset.context
        context.spend(math.inf if eps is None else step_cost(eps, rate, self.steps))
        total, n = gradient_sum(batch, self.model, None if eps is None else self.max_grad_norm)
        if eps is not None:  # a sample more or less moves the sum of clipped gradients by the bound at most, in L2
            total = total + noise(total.shape, sigma(eps, context.delta, self.max_grad_norm), context.rng)
        self.model.weights = self.optimizer.step(self.model.weights, total / (size if eps is not None else max(n, 1)))
        self.steps += 1

    def _short_steps(self, size: int, epoch: int, start: int, eps: float | None, rate: float, per_checkpoint: int, checkpoint: Callable[[int, int], None], progress: Callable[[int], None]) -> None:
        """An epoch's steps from batch ``start`` on where batches are small: a job takes as many as ``RUN_SAMPLES`` allows, up to the next checkpoint.
        Each is told and paid for before its job starts; those that are paid for are taken also if the budget ends before the next."""
        context, count, length = self.dataset.context, self.dataset.batch_count(size), max(RUN_SAMPLES // size, 1)
        std = 0.0 if eps is None else sigma(eps, context.delta, self.max_grad_norm)
        with self.dataset._dealt(size, epoch, self.seed, start, length) as part:
            at = start
            while at < count:
                end, refused = min((at // length + 1) * length, count), None
                if per_checkpoint:
                    end = min(end, at + per_checkpoint - self.steps % per_checkpoint)
                for k in range(at, end):
                    progress(k)
                    try:
                        context.spend(math.inf if eps is None else step_cost(eps, rate, self.steps + k - at))
                    except PermissionError as error:
                        end, refused = k, error
                        break
                if end > at:
                    weights, optimizer, done = run_steps(part(at, end), self.model, self.optimizer, None if eps is None else self.max_grad_norm, std, context.rng)
                    self.model.weights, self.steps, at = weights, self.steps + done, end
                    vars(self.optimizer).update(vars(optimizer))
                    if per_checkpoint and self.steps % per_checkpoint == 0:
                        checkpoint(epoch, at)
                if refused is not None:
                    raise refused

    def test(self, dataset: Dataset, metric: str = "l2", eps: float | None = None) -> tuple[float, float]:
        """(private mean of the metric over all samples, two deviations of its noise)."""
        return self.tests(dataset, [metric], eps)[0]

    def tests(self, dataset: Dataset, metrics: list[str], eps: float | None = None) -> list[tuple[float, float]]:
        """The same for each of several metrics, with ``eps`` each, from one pass over the samples."""
        sums, n = metric_sums(dataset.df, self.model, metrics)
        return [self._released(dataset, metric, total, n, eps) for metric, total in zip(metrics, sums, strict=True)]

    def _released(self, dataset: Dataset, metric: str, total: float, n: int, eps: float | None) -> tuple[float, float]:
        bound = 1.0 if metric == "accuracy" else 10.0
        guarded = Guarded(np.array(total), dataset.context, bound, frozenset([0])) / max(n, 1)
        value = float(guarded.release(eps))
        value = min(max(value, 0.0), bound)
        return (1 - value if metric == "accuracy" else value), 0.0 if eps is None else 2 * sigma(eps, dataset.context.delta, guarded.linf)


def metric_sums(df: DataFrame, model: Model | Network, metrics: list[str]) -> tuple[list[float], int]:
    """(sum of each clipped per-sample metric, samples); of accuracy it is the errors that are summed."""
    if not set(metrics) <= {"accuracy", "l2", "cross_entropy"}:
        raise ValueError("metric must be accuracy, l2 or cross_entropy")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                y, scores = part["y"].to_numpy(), shared.value.scores(part["x"].tolist())
                values = [np.clip(np.abs(scores.argmax(axis=1) - y), 0, 1) if metric == "accuracy" else np.clip(score_losses(scores, y, metric), 0, 10) for metric in metrics]
                yield pd.DataFrame({"i": range(-1, len(metrics)), "s": [float(len(y)), *[v.sum() for v in values]]})  # the number of samples goes as -1

    found = {r["i"]: r["s"] for r in df.select("x", "y").mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}  # a row for each metric
    return [found.get(i, 0.0) for i in range(len(metrics))], int(found.get(-1, 0))


@dataclass(frozen=True)
class TrainConfig:
    """What a run in the background is asked to do."""

    model: str
    dataset: str
    nb_epochs: int = 1
    eps: float | None = None
    batch_size: int = 64
    max_grad_norm: float = 1.0
    optimizer: str = "Adam"
    options: dict = field(default_factory=dict)  # of the optimiser
    per_n_steps_checkpoint: int = 0
    per_n_epochs_checkpoint: int = 1
    seed: int = field(default_factory=lambda: secrets.randbits(62))


#: Entries of a run's state that are kept.
STATES = 20


@dataclass
class Registry:
    """Models, data sets and runs by name; with a session and a folder ``store`` they are kept there and found again.

    A data set's budget is a ledger in the store: spending is committed before anything is released, and registries that share
    a store share its budgets.  Runs go on in threads of this driver, each under a job tag of its own, and keep their state in
    the store, where any session polls or cancels them; a run whose driver has gone is started again from its last checkpoint.
    """

    spark: SparkSession | None = None
    store: str | None = None
    models: dict[str, str] = field(default_factory=dict)
    datasets: dict[str, Dataset] = field(default_factory=dict)
    threads: dict[str, threading.Thread] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in self._names("models"):
            self.models[name] = self._text(f"models/{name}")
        for name in self._names("datasets"):
            about = json.loads(self._text(f"datasets/{name}/about"))
            context = PrivacyContext(about["limit"], about["n"], ledger=BudgetLedger(self.spark, f"{self.store}/datasets/{name}/budget"))
            self.datasets[name] = Dataset(self.spark.read.parquet(f"{self.store}/datasets/{name}/rows"), context, about["features"])

    def _names(self, kind: str) -> list[str]:
        return children(self.spark, f"{self.store}/{kind}") if self.store else []

    def _text(self, path: str) -> str:
        return self.spark.read.text(f"{self.store}/{path}").first()["value"]

    def _write(self, path: str, text: str) -> None:
        if self.store:
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.store}/{path}")

    def send_model(self, name: str, model: Model | Network) -> None:
        self.models[name] = model.to_json()
        self._write(f"models/{name}", self.models[name])

    def fetch_model(self, name: str) -> Model | Network:
        return model_from_json(self.models[name])

    def send_dataset(self, name: str, dataset: Dataset) -> None:
        """Keep a data set; from now on its budget is the ledger of that name, to which what it has spent is carried over."""
        if self.store:
            dataset.df.write.mode("overwrite").parquet(f"{self.store}/datasets/{name}/rows")
            c = dataset.context
            self._write(f"datasets/{name}/about", json.dumps({"limit": c.limit, "n": c.n, "features": dataset.features}))
            ledger = BudgetLedger(self.spark, f"{self.store}/datasets/{name}/budget")
            ledger.carry(c.spent, c.poisoned)
            c.ledger = ledger
            dataset = Dataset(self.spark.read.parquet(f"{self.store}/datasets/{name}/rows"), c, dataset.features)
        self.datasets[name] = dataset

    def delete(self, name: str) -> None:
        for kind, known in (("models", self.models), ("datasets", self.datasets)):
            if known.pop(name, None) is not None and self.store:
                remove_path(self.spark, f"{self.store}/{kind}/{name}")

    def available(self) -> dict[str, list[str]]:
        return {"models": sorted(self.models), "datasets": sorted(self.datasets), "devices": ["cpu"], "optimizers": ["SGD", "Adam"], "runs": self._names("runs")}

    # Runs.

    def _journal(self, run: str) -> Journal:
        if not self.store:
            raise ValueError("runs need a store")
        return Journal(self.spark, f"{self.store}/runs/{run}/state", STATES)

    def _launch(self, run: str, work: Callable[[Callable[..., None]], dict]) -> str:
        journal, tag = self._journal(run), f"cloister-{run}"

        def say(**state) -> None:
            journal.add(state | {"time": time.time()})

        def body() -> None:
            self.spark.addTag(tag)
            try:
                say(**{"status": "ok"} | work(say))
            except Exception as error:
                stopped = self._cancelled(run)
                say(status="cancelled" if stopped else "error", message="" if stopped else f"{type(error).__name__}: {str(error)[:2000]}")
            finally:
                self.spark.removeTag(tag)

        say(status="pending")
        self.threads[run] = threading.Thread(target=inheritable_thread_target(self.spark)(body), daemon=True, name=tag)
        self.threads[run].start()
        return run

    def _cancelled(self, run: str) -> bool:
        return read_bytes(self.spark, f"{self.store}/runs/{run}/cancel") is not None

    def train(self, config: TrainConfig, run: str | None = None) -> str:
        """Start a training in the background and return the run's name; the trained model replaces the one of that name.

        With the name of a run that has ended, been cancelled or lost its driver, the training goes on from its last checkpoint under its own configuration.
        """
        if run is None:
            run = uuid.uuid4().hex
            commit_bytes(self.spark, f"{self.store}/runs/{run}/config.json", json.dumps(asdict(config)).encode())
        else:
            config = TrainConfig(**json.loads(read_bytes(self.spark, f"{self.store}/runs/{run}/config.json")))
            if run in self.threads and self.threads[run].is_alive():
                raise ValueError(f"run {run} has not ended")
            remove_path(self.spark, f"{self.store}/runs/{run}/cancel")
        dataset, model = self.datasets[config.dataset], self.fetch_model(config.model)

        def work(say) -> dict:
            def progress(epoch: int, step: int, of: int) -> None:
                if self._cancelled(run):
                    raise Cancelled(run)
                say(status="running", epoch=epoch, step=step, of=of)

            learner = Learner(model, dataset, OPTIMIZERS[config.optimizer](**config.options), config.batch_size, config.max_grad_norm, seed=config.seed)
            kept = Checkpoints(self.spark, f"{self.store}/runs/{run}/checkpoints")
            learner.fit(config.nb_epochs, config.eps, config.batch_size, config.per_n_steps_checkpoint, config.per_n_epochs_checkpoint, True, kept, progress)
            self.send_model(config.model, learner.model)
            return {"step": learner.steps, "of": learner.steps}

        return self._launch(run, work)

    def test(self, model: str, dataset: str, metric: str = "l2", eps: float | None = None) -> str:
        """Start a test in the background; the metric and its uncertainty are in the run's last state."""
        learner, data = Learner(self.fetch_model(model), self.datasets[dataset]), self.datasets[dataset]

        def work(say) -> dict:
            value, uncertainty = learner.test(data, metric, eps)
            return {"metric": metric, "value": value, "uncertainty": uncertainty}

        return self._launch(uuid.uuid4().hex, work)

    def poll(self, run: str) -> dict:
        """A run's last state: ``status`` (pending, running, ok, error, cancelled), ``time``, and what it has to say."""
        found = self._journal(run).last()[1]
        if found is None:
            raise KeyError(run)
        return found

    def wait(self, run: str, timeout: float = 100.0, delay: float = 0.2) -> dict:
        """The state in which a run ends; TimeoutError if none of its states changes for ``timeout`` seconds."""
        journal, seen, since = self._journal(run), -1, time.monotonic()
        while True:
            number, state = journal.last()
            if state is not None and state["status"] not in ("pending", "running"):
                return state
            if number != seen:
                seen, since = number, time.monotonic()
            if time.monotonic() - since > timeout:
                raise TimeoutError(f"run {run} has said nothing new for {timeout:g} s")
            time.sleep(delay)

    def cancel(self, run: str) -> None:
        """Ask a run to stop: its Spark jobs in this application are stopped now, and it starts no other step."""
        self.poll(run)
        commit_bytes(self.spark, f"{self.store}/runs/{run}/cancel", b"")
        self.spark.interruptTag(f"cloister-{run}")
