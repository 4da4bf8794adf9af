"""Layers with per-sample gradients for private training, in batched numpy on executors.

A batch of samples is one matrix of positions (rows) and channels, with the first position of each sample: a vector is a
sample of one position, a text one of as many positions as it has tokens, an image one of a position for each pixel.  So texts
of any length are trained on whole, without padding.

Every layer finds, from the errors at its outputs, the errors at its inputs and the squared norm of each sample's own gradient.
The gradient of a linear map is the sum over a sample's positions of (error x input), whose squared norm is that of the
positions' two Gram matrices, multiplied element by element and summed, so it is never built where it is larger than those.
A sample's factor then scales its errors, and one product over all positions gives the sum of the clipped gradients.  Of a
look-up table only the rows that a sample touches have gradients, which are summed by row.  Where nothing is clipped, no norms are
found, and layers after a look-up table that look at one position alone go over its rows, not over the positions that have them.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np

#: Positions that are worked on at once; a longer sample is a slice of its own.
SLICE_POSITIONS = 1 << 15


@dataclass
class Positions:
    """``data`` (positions, channels) and the first position of each sample, with the end."""

    data: np.ndarray
    first: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def single(self) -> bool:
        return len(self.data) == len(self.first) - 1 and bool((self.lengths == 1).all())

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.lengths)


def segment_sums(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(samples, channels): sums over each sample's positions; samples without any have zeros."""
    total = np.zeros((len(first) - 1, data.shape[1]))
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        total[filled] = np.add.reduceat(data, first[filled], axis=0)
    return total


class Layer:
    """``shapes`` of its parameters; ``fans`` says what their first values are scaled by (0: zeros, -1: ones).  A ``local`` layer looks at one position alone."""

    local = False

    def shapes(self) -> list[tuple[int, ...]]:
        return []

    def fans(self) -> list[int]:
        return []

    def forward(self, x: Positions, w: list[np.ndarray]) -> tuple[Positions, object]:
        """(output, what ``backward`` needs)."""
        raise NotImplementedError

    def backward(self, error: np.ndarray, kept, w: list[np.ndarray]) -> np.ndarray | None:
        """Errors at the inputs; None where they are no numbers to be learned."""
        raise NotImplementedError

    def norms(self, error: np.ndarray, kept) -> np.ndarray | float:
        """Squared norm of each sample's gradient."""
        return 0.0

    def gradients(self, error: np.ndarray, kept) -> list[tuple[np.ndarray | slice, np.ndarray]]:
        """For each parameter the rows that have a gradient, and its sum over all samples."""
        return []


@dataclass
class Linear(Layer):
    inputs: int
    outputs: int
    bias: bool = True
    local = True

    def shapes(self):
        return [(self.outputs, self.inputs), *([(self.outputs,)] if self.bias else [])]

    def fans(self):
        return [self.inputs, *([self.inputs] if self.bias else [])]

    def forward(self, x, w):
        y = x.data @ w[0].T
        return Positions(y + w[1] if self.bias else y, x.first), x

    def backward(self, error, x, w):
        return error @ w[0]

    def norms(self, error, x):
        if x.single:
            out = (error**2).sum(1) * (x.data**2).sum(1)
        else:
            out = np.zeros(len(x.first) - 1)
            for s, (a, b) in enumerate(itertools.pairwise(x.first)):
                e, own = error[a:b], x.data[a:b]
                if (b - a) ** 2 < self.inputs * self.outputs:
                    out[s] = ((e @ e.T) * (own @ own.T)).sum()
                else:
                    out[s] = ((e.T @ own) ** 2).sum()
        if self.bias:
            out = out + ((error if x.single else segment_sums(error, x.first)) ** 2).sum(1)
        return out

    def gradients(self, error, x):
        return [(slice(None), error.T @ x.data), *([(slice(None), error.sum(0))] if self.bias else [])]


@dataclass
class Embedding(Layer):
    """Rows of a table by number; ``padding`` names one that gives zeros and is not learned."""

    rows: int
    outputs: int
    padding: int | None = None

    def shapes(self):
        return [(self.rows, self.outputs)]

    def fans(self):
        return [1]

    def ids(self, x: Positions) -> np.ndarray:
        ids = x.data[:, 0].astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.rows):
            raise ValueError(f"row numbers must be from 0 to {self.rows - 1}")
        return ids

    def forward(self, x, w):
        ids = self.ids(x)
        y = w[0][ids]
        if self.padding is not None:
            y[ids == self.padding] = 0.0
        return Positions(y, x.first), (ids, x.owners(), len(x.first) - 1)

    def backward(self, error, kept, w):
        return None

    def _touched(self, error, ids, groups):
        """Sums of errors by (group, row), without the padding's."""
        own = np.flatnonzero(ids != self.padding) if self.padding is not None else np.arange(len(ids))
        key = groups[own] * self.rows + ids[own]
        order = np.argsort(key, kind="stable")
        found, start = np.unique(key[order], return_index=True)
        return found, np.add.reduceat(error[own[order]], start, axis=0) if len(found) else np.zeros((0, self.outputs))

    def norms(self, error, kept):
        ids, owners, samples = kept
        found, sums = self._touched(error, ids, owners)
        return np.bincount(found // self.rows, (sums**2).sum(1), minlength=samples)

    def gradients(self, error, kept):
        return [self._touched(error, kept[0], np.zeros(len(kept[0]), np.int64))]


@dataclass
class LayerNorm(Layer):
    """Each position's channels, less their mean and over their deviation, times a weight and plus a bias."""

    channels: int
    eps: float = 1e-5
    local = True

    def shapes(self):
        return [(self.channels,), (self.channels,)]

    def fans(self):
        return [-1, 0]

    def forward(self, x, w):
        centred = x.data - x.data.mean(1, keepdims=True)
        scale = 1 / np.sqrt((centred**2).mean(1, keepdims=True) + self.eps)
        unit = centred * scale
        return Positions(unit * w[0] + w[1], x.first), (unit, scale, x.first)

    def backward(self, error, kept, w):
        unit, scale, _ = kept
        e = error * w[0]
        return scale * (e - e.mean(1, keepdims=True) - unit * (e * unit).mean(1, keepdims=True))

    def norms(self, error, kept):
        unit, _, first = kept
        return (segment_sums(error * unit, first) ** 2).sum(1) + (segment_sums(error, first) ** 2).sum(1)

    def gradients(self, error, kept):
        return [(slice(None), (error * kept[0]).sum(0)), (slice(None), error.sum(0))]


@dataclass
class MeanPool(Layer):
    """A sample's mean over its positions; zeros for one without any."""

    def forward(self, x, w):
        n = np.maximum(x.lengths, 1)[:, None]
        return Positions(segment_sums(x.data, x.first) / n, np.arange(len(x.first))), (n, x.lengths)

    def backward(self, error, kept, w):
        n, lengths = kept
        return np.repeat(error / n, lengths, axis=0)


@dataclass
class ReLU(Layer):
    local = True

    def forward(self, x, w):
        return Positions(np.maximum(x.data, 0), x.first), x.data > 0

    def backward(self, error, kept, w):
        return error * kept


@dataclass
class Tanh(Layer):
    local = True

    def forward(self, x, w):
        y = np.tanh(x.data)
        return Positions(y, x.first), y

    def backward(self, error, kept, w):
        return error * (1 - kept**2)


@dataclass
class Identity(Layer):
    """Stands in for layers that mix samples, such as batch normalisation, which have no per-sample gradient."""

    local = True

    def forward(self, x, w):
        return x, None

    def backward(self, error, kept, w):
        return error


@dataclass
class Grid(Layer):
    """A vector as an image: ``channels`` values for each position of a grid, given channel by channel."""

    channels: int

    def forward(self, x, w):
        n, width = len(x.data), x.data.shape[1] // self.channels
        return Positions(x.data.reshape(n, self.channels, width).transpose(0, 2, 1).reshape(n * width, self.channels), np.arange(n + 1) * width), (n, width)

    def backward(self, error, kept, w):
        n, width = kept
        return error.reshape(n, width, self.channels).transpose(0, 2, 1).reshape(n, -1)


@dataclass
class Flatten(Layer):
    """Samples of equally many positions as vectors, channel by channel."""

    def forward(self, x, w):
        n, width = len(x.first) - 1, int(x.lengths[0]) if len(x.first) > 1 else 0
        if (x.lengths != width).any():
            raise ValueError("samples of different lengths have no vectors of one size")
        return Positions(x.data.reshape(n, width, -1).transpose(0, 2, 1).reshape(n, -1), np.arange(n + 1)), (n, width)

    def backward(self, error, kept, w):
        n, width = kept
        return error.reshape(n, -1, width).transpose(0, 2, 1).reshape(n * width, -1)


@functools.lru_cache(maxsize=64)
def _taps(grid: tuple[int, ...], kernel: tuple[int, ...], stride: tuple[int, ...], padding: tuple[int, ...], dilation: tuple[int, ...]) -> np.ndarray:
    """(output positions, taps) -> input position, or -1 beyond the edge."""
    index = np.zeros((1, 1), np.int64)
    outside = np.zeros((1, 1), bool)
    for size, k, s, p, d in zip(grid, kernel, stride, padding, dilation, strict=True):
        count = max(0, (size + 2 * p - d * (k - 1) - 1) // s + 1)
        at = np.arange(count)[:, None] * s - p + np.arange(k) * d
        shape = (len(index) * count, index.shape[1] * k)
        index = (index[:, None, :, None] * size + np.clip(at, 0, max(size - 1, 0))[None, :, None, :]).reshape(shape)
        outside = (outside[:, None, :, None] | ((at < 0) | (at >= size))[None, :, None, :]).reshape(shape)
    return np.where(outside, -1, index)


@dataclass
class Unfold(Layer):
    """Each window's positions side by side; a linear layer on them is a convolution (``conv``).

    ``grid`` is the shape of every sample; None for sequences of any length.
    """

    channels: int
    kernel: tuple[int, ...]
    stride: tuple[int, ...]
    padding: tuple[int, ...]
    dilation: tuple[int, ...]
    grid: tuple[int, ...] | None = None

    def _windows(self, x: Positions) -> tuple[np.ndarray, np.ndarray]:
        """(input position of each tap, -1 outside; first output position of each sample)."""
        shape = lambda v: tuple(v)
        parts, first = [np.zeros((0, math.prod(self.kernel)), np.int64)], [0]
        for a, b in itertools.pairwise(x.first.tolist()):
            grid = shape(self.grid) if self.grid else (b - a,)
            if math.prod(grid) != b - a:
                raise ValueError(f"a sample of {b - a} positions is not a grid of {grid}")
            taps = _taps(grid, shape(self.kernel), shape(self.stride), shape(self.padding), shape(self.dilation))
            parts.append(np.where(taps >= 0, taps + a, -1))
            first.append(first[-1] + len(taps))
        return np.concatenate(parts), np.array(first)

    def forward(self, x, w):
        taps, first = self._windows(x)
        padded = np.concatenate((x.data, np.zeros((1, self.channels))))  # the last row stands for positions outside
        y = padded[taps].transpose(0, 2, 1).reshape(len(taps), self.channels * taps.shape[1])  # channel by channel, as the weights of convolutions are
        return Positions(y, first), (taps, len(x.data))

    def backward(self, error, kept, w):
        taps, n = kept
        out = np.zeros((n + 1, self.channels))
        np.add.at(out, taps.ravel(), error.reshape(len(taps), self.channels, taps.shape[1]).transpose(0, 2, 1).reshape(-1, self.channels))
        return out[:n]


def conv(inputs: int, outputs: int, kernel, stride=1, padding=0, dilation=1, grid=None, bias: bool = True) -> list[Layer]:
    """A convolution over one axis (sequences of any length, or a ``grid`` of one number) or over the axes of ``grid``."""
    axes = len(grid) if grid else 1
    wide = lambda v: (v,) * axes if isinstance(v, int) else tuple(v)
    return [Unfold(inputs, wide(kernel), wide(stride), wide(padding), wide(dilation), tuple(grid) if grid else None), Linear(inputs * math.prod(wide(kernel)), outputs, bias)]


@dataclass
class TableRows(Layer):
    """A look-up table and the local layers after it, over the rows that occur in a slice instead of over its positions.  The errors of a
    row's positions are summed first, which is all that sums of gradients need; samples have no norms here."""

    layers: list[Layer]

    def shapes(self):
        return [shape for layer in self.layers for shape in layer.shapes()]

    def forward(self, x, w):
        table, rest = self.layers[0], iter(w)
        ids = table.ids(x)
        if table.rows > len(ids):
            found, at = np.unique(ids, return_inverse=True)
        else:
            found = np.flatnonzero(np.bincount(ids, minlength=table.rows))
            place = np.zeros(table.rows, np.int64)
            place[found] = np.arange(len(found))
            at = place[ids]
        y, kept = Positions(found[:, None], np.arange(len(found) + 1)), []
        for layer in self.layers:
            own = list(itertools.islice(rest, len(layer.shapes())))
            y, inner = layer.forward(y, own)
            kept.append((layer, inner, own))
        return Positions(y.data[at], x.first), (at, len(found), kept)

    def gradients(self, error, kept):
        at, n, inner = kept
        error = np.stack([np.bincount(at, channel, minlength=n) for channel in error.T], axis=1)
        out = []
        for layer, own, w in reversed(inner):
            out = [*layer.gradients(error, own), *out]
            error = layer.backward(error, own, w)
        return out


LAYERS = {c.__name__: c for c in (Linear, Embedding, LayerNorm, MeanPool, ReLU, Tanh, Identity, Grid, Flatten, Unfold)}


def score_errors(scores: np.ndarray, y: np.ndarray, loss: str) -> np.ndarray:
    """Derivative of each sample's loss by its scores."""
    if loss == "l2":
        return 2 * (scores - y[:, None]) / scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y.astype(int)] -= 1
    return p


def score_losses(scores: np.ndarray, y: np.ndarray, loss: str) -> np.ndarray:
    if loss == "l2":
        return ((scores - y[:, None]) ** 2).mean(axis=1)
    m = scores.max(axis=1, keepdims=True)
    return (np.log(np.exp(scores - m).sum(axis=1)) + m[:, 0]) - scores[np.arange(len(y)), y.astype(int)]


@dataclass
class Network:
    """Layers, one flat vector of all their parameters, and the loss "l2" or "cross_entropy"; each sample ends as one position."""

    layers: list[Layer]
    loss: str = "cross_entropy"
    weights: np.ndarray = field(default=None)  # type: ignore[assignment]
    seed: int = 0

    def __post_init__(self) -> None:
        if self.weights is None:
            rng, parts = np.random.default_rng(self.seed), [np.zeros(0)]
            for layer in self.layers:
                for shape, fan in zip(layer.shapes(), layer.fans(), strict=True):
                    size = math.prod(shape)
                    parts.append(np.ones(size) if fan < 0 else np.zeros(size) if not fan else rng.uniform(-1, 1, size) / math.sqrt(fan))
            self.weights = np.concatenate(parts)

    def grouped(self) -> list[Layer]:
        """The layers where no sample's norm is asked for."""
        n = 0
        if isinstance(self.layers[0], Embedding):
            n = next((k for k, layer in enumerate(self.layers) if k and not layer.local), len(self.layers))
        return [TableRows(self.layers[:n]), *self.layers[n:]] if n else self.layers

    def parameters(self, layers: list[Layer] | None = None) -> list[list[np.ndarray]]:
        """Views of ``weights`` for each layer."""
        out, at = [], 0
        for layer in self.layers if layers is None else layers:
            own = []
            for shape in layer.shapes():
                size = math.prod(shape)
                own.append(self.weights[at : at + size].reshape(shape))
                at += size
            out.append(own)
        return out

    def run(self, x: Positions, layers: list[Layer]) -> tuple[np.ndarray, list, list[Positions]]:
        """(scores, what each layer kept, its output)."""
        kept, outputs = [], []
        for layer, w in zip(layers, self.parameters(layers), strict=True):
            x, own = layer.forward(x, w)
            kept.append(own)
            outputs.append(x)
        if not x.single:
            raise ValueError("the last layer must leave one position for each sample")
        return x.data, kept, outputs

    def slices(self, x) -> list[tuple[int, int, Positions]]:
        """Runs of samples of a bounded number of positions; ``x`` holds a vector, or a sequence of numbers, for each sample."""
        lengths = np.array([len(v) for v in x], np.int64)
        vectors = not isinstance(self.layers[0], Embedding)
        sizes = np.ones(len(x), np.int64) if vectors else lengths
        if vectors and isinstance(self.layers[0], Grid):
            sizes = np.maximum(lengths // self.layers[0].channels, 1)
        out, at = [], 0
        while at < len(x):
            total = np.cumsum(sizes[at:])
            end = at + max(1, int(np.searchsorted(total, SLICE_POSITIONS, side="right")))
            data = np.concatenate([np.asarray(v, float) for v in x[at:end]]) if end > at else np.zeros(0)
            if vectors:
                out.append((at, end, Positions(data.reshape(end - at, -1), np.arange(end - at + 1))))
            else:
                out.append((at, end, Positions(data[:, None], np.concatenate(([0], np.cumsum(lengths[at:end]))))))
            at = end
        return out

    def scores(self, x) -> np.ndarray:
        layers = self.grouped()
        found = [self.run(part, layers)[0] for _, _, part in self.slices(x)]
        return np.concatenate(found) if found else np.zeros((0, 1))

    def losses(self, x, y: np.ndarray) -> np.ndarray:
        return score_losses(self.scores(x), y, self.loss)

    def clipped_gradients(self, x, y: np.ndarray, max_norm: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(sum of per-sample gradients, each scaled to norm ``max_norm`` at most, as a flat vector; which parameters any sample touches)."""
        total, touched = np.zeros(len(self.weights)), np.zeros(len(self.weights), bool)
        layers = self.grouped() if max_norm is None else self.layers
        parameters = self.parameters(layers)
        for start, end, part in self.slices(x):
            scores, kept, outputs = self.run(part, layers)
            error, errors, squares = score_errors(scores, y[start:end], self.loss), [None] * len(layers), np.zeros(end - start)
            for k in range(len(layers) - 1, -1, -1):
                errors[k] = error
                if max_norm is not None:
                    squares += layers[k].norms(error, kept[k])
                if k:
                    error = layers[k].backward(error, kept[k], parameters[k])
            factor = None if max_norm is None else np.minimum(1, max_norm / (np.sqrt(squares) + 1e-6))
            at = 0
            for layer, error, own, output in zip(layers, errors, kept, outputs, strict=True):
                shapes = layer.shapes()
                if shapes and factor is not None:
                    error = error * factor[output.owners(), None]
                for shape, (rows, g) in zip(shapes, layer.gradients(error, own) if shapes else [], strict=True):
                    size = math.prod(shape)
                    total[at : at + size].reshape(shape)[rows] += g
                    touched[at : at + size].reshape(shape)[rows] = True
                    at += size
        return total, touched

    def to_json(self) -> str:
        layers = [[type(layer).__name__, asdict(layer)] for layer in self.layers]
        return json.dumps({"layers": layers, "loss": self.loss, "weights": self.weights.tolist()})

    @staticmethod
    def from_json(text: str) -> Network:
        data = json.loads(text)
        tuples = lambda args: {k: tuple(v) if isinstance(v, list) else v for k, v in args.items()}
        return Network([LAYERS[name](**tuples(args)) for name, args in data["layers"]], data["loss"], np.array(data["weights"]))
