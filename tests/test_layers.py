"""Per-sample gradients of layers against central differences, and of batches against one sample at a time."""

import numpy as np
import pytest

from cloister.operators.layers import Embedding, Flatten, Grid, Identity, LayerNorm, Linear, MeanPool, Network, Positions, ReLU, Tanh, conv

RNG = np.random.default_rng(5)


def texts(n, rows=7, least=0):
    return [RNG.integers(0, rows, RNG.integers(least, 9)).tolist() for _ in range(n)]


def vectors(n, width):
    return RNG.normal(size=(n, width)).tolist()


NETWORKS = {
    "linear": (lambda: [Linear(4, 3)], vectors(6, 4)),
    "no bias": (lambda: [Linear(4, 5, bias=False), Tanh(), Linear(5, 3)], vectors(6, 4)),
    "embedding": (lambda: [Embedding(7, 4), MeanPool(), Linear(4, 3)], texts(8)),
    "padding": (lambda: [Embedding(7, 4, padding=2), LayerNorm(4), Linear(4, 6), ReLU(), MeanPool(), LayerNorm(6), Linear(6, 3)], texts(8)),
    "wide linear on texts": (lambda: [Embedding(7, 3), Linear(3, 2), Tanh(), MeanPool(), Linear(2, 3)], texts(8)),
    "conv over texts": (lambda: [Embedding(7, 4), *conv(4, 5, 3, padding=1), Tanh(), MeanPool(), Linear(5, 3)], texts(8)),
    "strided, dilated": (lambda: [Embedding(7, 4), *conv(4, 5, 2, stride=2, padding=2, dilation=3), Tanh(), MeanPool(), Linear(5, 3)], texts(8)),
    "conv1d": (lambda: [Grid(2), *conv(2, 3, 3, grid=(6,)), Tanh(), Flatten(), Linear(12, 3)], vectors(5, 12)),
    "conv2d": (lambda: [Grid(2), *conv(2, 3, (2, 3), stride=(1, 2), padding=1, grid=(4, 5)), Identity(), Tanh(), Flatten(), Linear(3 * 5 * 3, 3)], vectors(4, 40)),
    "conv3d": (lambda: [Grid(1), *conv(1, 2, 2, grid=(2, 3, 3)), Tanh(), Flatten(), Linear(8, 3)], vectors(4, 18)),
}


@pytest.mark.parametrize("name", NETWORKS)
@pytest.mark.parametrize("loss", ["cross_entropy", "l2"])
def test_gradients(name, loss, monkeypatch):
    make, x = NETWORKS[name]
    net = Network([*make(), *([Linear(3, 1)] if loss == "l2" else [])], loss, seed=3)
    net.weights = net.weights + RNG.normal(0, 0.1, net.weights.size)
    y = RNG.integers(0, 3, len(x)).astype(float)
    total, touched = net.clipped_gradients(x, y, None)
    numeric = np.zeros_like(total)
    for i in range(len(total)):
        for sign in (1, -1):
            moved = Network(net.layers, loss, net.weights.copy())
            moved.weights[i] += sign * 1e-5
            numeric[i] += sign * moved.losses(x, y).sum() / 2e-5
    assert np.allclose(total, numeric, atol=1e-6) and not numeric[~touched].any()
    # Clipping: each sample's own gradient, scaled by its own norm.
    each = [net.clipped_gradients(x[i : i + 1], y[i : i + 1], None)[0] for i in range(len(x))]
    bound = float(np.median([np.linalg.norm(g) for g in each]))
    expected = sum(g * min(1, bound / (np.linalg.norm(g) + 1e-6)) for g in each)
    assert np.allclose(net.clipped_gradients(x, y, bound)[0], expected)
    monkeypatch.setattr("cloister.operators.layers.SLICE_POSITIONS", 5)
    assert np.allclose(net.clipped_gradients(x, y, bound)[0], expected)
    again = Network.from_json(net.to_json())
    assert np.array_equal(again.scores(x), net.scores(x))


def test_convolution_as_its_definition():
    net = Network([Grid(2), *conv(2, 3, (2, 2), padding=1, grid=(3, 4)), Flatten()], "l2", seed=1)
    x = RNG.normal(size=(2, 24))
    out = net.scores(x)
    (w, b) = net.parameters()[2]
    image = np.pad(x.reshape(2, 2, 3, 4), ((0, 0), (0, 0), (1, 1), (1, 1)))
    kernel = w.reshape(3, 2, 2, 2)
    expected = np.array([[[[(image[s, :, i : i + 2, j : j + 2] * kernel[o]).sum() + b[o] for j in range(5)] for i in range(4)] for o in range(3)] for s in range(2)])
    assert np.allclose(out, expected.reshape(2, -1))


def test_bad_input():
    net = Network([Embedding(3, 2), MeanPool(), Linear(2, 2)])
    with pytest.raises(ValueError, match="row numbers"):
        net.scores([[3]])
    with pytest.raises(ValueError, match="one position"):
        Network([Embedding(3, 2)]).scores([[1, 2]])
    with pytest.raises(ValueError, match="lengths"):
        Network([Embedding(3, 2), Flatten()]).scores([[1, 2], [1]])
    with pytest.raises(ValueError, match="grid"):
        Network([Embedding(3, 2), *conv(2, 2, 1, grid=(3,)), MeanPool()]).scores([[1, 2]])
    assert net.scores([]).shape[0] == 0 and np.array_equal(net.clipped_gradients([], np.zeros(0), 1.0)[0], np.zeros(12))
    assert Positions(np.zeros((0, 2)), np.zeros(1, int)).single


@pytest.mark.parametrize("name", ["embedding", "padding", "wide linear on texts", "conv over texts"])
def test_local_layers_go_over_rows_of_the_table(name, monkeypatch):
    """Where nothing is clipped, no norms are found and layers of single positions see each row of a table once; sums are those of all positions."""
    make, _ = NETWORKS[name]
    net, x, y = Network(make(), seed=3), texts(40, least=6), RNG.integers(0, 3, 40).astype(float)
    whole, at = net.clipped_gradients(x, y, 1e300)
    seen = []
    forward = LayerNorm.forward
    monkeypatch.setattr(LayerNorm, "forward", lambda self, p, w: seen.append(len(p.data)) or forward(self, p, w))
    for layer in (Linear, LayerNorm, Embedding):
        monkeypatch.setattr(layer, "norms", lambda *_: pytest.fail("norms of samples"))
    total, touched = net.clipped_gradients(x, y, None)
    assert np.allclose(total, whole) and np.array_equal(touched, at)
    assert not seen or seen[0] <= 7
