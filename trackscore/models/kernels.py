"""Forward and gradient of the two reconstruction models, on NumPy batches.

These run inside Spark tasks; ``training`` spreads batches, averages parameters
and keeps the history.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..functions.vectors import to_matrix, to_tensor

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _kl(mu: np.ndarray, logvar: np.ndarray) -> float:
    return float(-0.5 * np.sum(1 + logvar - np.square(mu) - np.exp(logvar)))


def _latent_gradients(dz, mu, logvar, eps):
    """Gradients of reconstruction and KL terms through the reparameterised latent."""
    spread = np.exp(0.5 * logvar)
    return dz + mu, 0.5 * (dz * eps * spread + np.square(spread) - 1)


class _Dense:
    """Bookkeeping of dense layers: forward, and backward into a gradient dict."""

    def __init__(self, params: Params):
        self.params, self.grads = params, {}

    def forward(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.params[f"{name}.w"] + self.params[f"{name}.b"]

    def backward(self, name: str, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        width_in, width_out = x.shape[-1], d.shape[-1]
        flat_x, flat_d = x.reshape(-1, width_in), d.reshape(-1, width_out)
        self.grads[f"{name}.w"] = flat_x.T @ flat_d
        self.grads[f"{name}.b"] = flat_d.sum(axis=0)
        return d @ self.params[f"{name}.w"].T


@dataclass(frozen=True)
class FlatVAE:
    """Dense encoder and decoder with a sigmoid output, for single vectors."""

    input_dim: int
    hidden_dim: int = 128
    latent_dim: int = 32

    def shapes(self) -> dict[str, tuple[int, ...]]:
        d, h, z = self.input_dim, self.hidden_dim, self.latent_dim
        layers = {"enc1": (d, h), "enc2": (h, h), "mu": (h, z), "logvar": (h, z),
                  "dec1": (z, h), "dec2": (h, h), "out": (h, d)}
        return _dense_shapes(layers)

    def read(self, column: pa.Array) -> np.ndarray:
        return to_matrix(column)

    def forward(self, params: Params, x: np.ndarray):
        """Reconstruction from the mean latent, with mean and log variance."""
        net = _Dense(params)
        hidden = np.maximum(net.forward("enc2", np.maximum(net.forward("enc1", x), 0)), 0)
        mu, logvar = net.forward("mu", hidden), net.forward("logvar", hidden)
        back = np.maximum(net.forward("dec2", np.maximum(net.forward("dec1", mu), 0)), 0)
        return _sigmoid(net.forward("out", back)), mu, logvar

    def step(self, params: Params, x: np.ndarray, eps: np.ndarray):
        """(recon, kl) sums of a batch and the gradient of their total."""
        net = _Dense(params)
        e1 = np.maximum(net.forward("enc1", x), 0)
        e2 = np.maximum(net.forward("enc2", e1), 0)
        mu, logvar = net.forward("mu", e2), net.forward("logvar", e2)
        z = mu + eps * np.exp(0.5 * logvar)
        d1 = np.maximum(net.forward("dec1", z), 0)
        d2 = np.maximum(net.forward("dec2", d1), 0)
        out = _sigmoid(net.forward("out", d2))
        error = out - x
        g = net.backward("out", d2, 2 * error * out * (1 - out)) * (d2 > 0)
        g = net.backward("dec2", d1, g) * (d1 > 0)
        dmu, dlogvar = _latent_gradients(net.backward("dec1", z, g), mu, logvar, eps)
        g = (net.backward("mu", e2, dmu) + net.backward("logvar", e2, dlogvar)) * (e2 > 0)
        g = net.backward("enc2", e1, g) * (e1 > 0)
        net.backward("enc1", x, g)
        return float(np.square(error).sum()), _kl(mu, logvar), net.grads


@dataclass(frozen=True)
class SequenceVAE:
    """LSTM encoder and decoder around one latent per window."""

    input_dim: int
    hidden_dim: int = 128
    latent_dim: int = 32

    def shapes(self) -> dict[str, tuple[int, ...]]:
        d, h, z = self.input_dim, self.hidden_dim, self.latent_dim
        shapes = _dense_shapes({"mu": (h, z), "logvar": (h, z), "out": (h, d)})
        for name, width in (("enc", d), ("dec", z)):
            shapes |= {f"{name}.wx": (width, 4 * h), f"{name}.wh": (h, 4 * h),
                       f"{name}.bx": (4 * h,), f"{name}.bh": (4 * h,)}
        return shapes

    def read(self, column: pa.Array) -> np.ndarray:
        return to_tensor(column)

    def forward(self, params: Params, x: np.ndarray):
        net = _Dense(params)
        last = _lstm(params, "enc", x)[0][:, -1]
        mu, logvar = net.forward("mu", last), net.forward("logvar", last)
        hidden = _lstm(params, "dec", np.repeat(mu[:, None, :], x.shape[1], axis=1))[0]
        return net.forward("out", hidden), mu, logvar

    def step(self, params: Params, x: np.ndarray, eps: np.ndarray):
        net = _Dense(params)
        states, trace = _lstm(params, "enc", x)
        last = states[:, -1]
        mu, logvar = net.forward("mu", last), net.forward("logvar", last)
        z = mu + eps * np.exp(0.5 * logvar)
        repeated = np.repeat(z[:, None, :], x.shape[1], axis=1)
        hidden, back_trace = _lstm(params, "dec", repeated)
        error = net.forward("out", hidden) - x
        dhidden = net.backward("out", hidden, 2 * error)
        dz = _lstm_backward(params, "dec", repeated, hidden, back_trace, dhidden, net.grads).sum(axis=1)
        dmu, dlogvar = _latent_gradients(dz, mu, logvar, eps)
        dstates = np.zeros_like(states)
        dstates[:, -1] = net.backward("mu", last, dmu) + net.backward("logvar", last, dlogvar)
        _lstm_backward(params, "enc", x, states, trace, dstates, net.grads)
        return float(np.square(error).sum()), _kl(mu, logvar), net.grads


def _dense_shapes(layers: dict[str, tuple[int, int]]) -> dict[str, tuple[int, ...]]:
    shapes: dict[str, tuple[int, ...]] = {}
    for name, (width_in, width_out) in layers.items():
        shapes |= {f"{name}.w": (width_in, width_out), f"{name}.b": (width_out,)}
    return shapes


def _lstm(params: Params, name: str, x: np.ndarray):
    """Hidden states (B, T, H) and what the backward pass needs."""
    batch, length, _ = x.shape
    wh = params[f"{name}.wh"]
    size = wh.shape[0]
    driven = x @ params[f"{name}.wx"] + params[f"{name}.bx"] + params[f"{name}.bh"]
    h, c = np.zeros((batch, size)), np.zeros((batch, size))
    states, trace = np.empty((batch, length, size)), []
    for t in range(length):
        gates = driven[:, t] + h @ wh
        take, keep, out = (_sigmoid(gates[:, k * size:(k + 1) * size]) for k in (0, 1, 3))
        new = np.tanh(gates[:, 2 * size:3 * size])
        before, c = c, keep * c + take * new
        h = out * np.tanh(c)
        states[:, t] = h
        trace.append((take, keep, new, out, before, c))
    return states, trace


def _lstm_backward(params: Params, name: str, x, states, trace, dstates, grads: Params) -> np.ndarray:
    """Backpropagation through time; fills ``grads`` and returns the input gradient."""
    batch, length, size = states.shape
    wh = params[f"{name}.wh"]
    dh, dc = np.zeros((batch, size)), np.zeros((batch, size))
    dgates = np.empty((batch, length, 4 * size))
    for t in reversed(range(length)):
        take, keep, new, out, before, c = trace[t]
        dh = dh + dstates[:, t]
        squashed = np.tanh(c)
        dc = dc + dh * out * (1 - np.square(squashed))
        dgates[:, t] = np.concatenate([
            dc * new * take * (1 - take), dc * before * keep * (1 - keep),
            dc * take * (1 - np.square(new)), dh * squashed * out * (1 - out)], axis=1)
        dh, dc = dgates[:, t] @ wh.T, dc * keep
    earlier = np.concatenate([np.zeros((batch, 1, size)), states[:, :-1]], axis=1)
    flat = dgates.reshape(-1, 4 * size)
    grads[f"{name}.wx"] = x.reshape(-1, x.shape[-1]).T @ flat
    grads[f"{name}.wh"] = earlier.reshape(-1, size).T @ flat
    grads[f"{name}.bx"] = grads[f"{name}.bh"] = flat.sum(axis=0)
    return dgates @ params[f"{name}.wx"].T


Kernel = FlatVAE | SequenceVAE


def n_parameters(kernel: Kernel) -> int:
    return sum(int(np.prod(s)) for s in kernel.shapes().values())


def pack(kernel: Kernel, params: Params) -> np.ndarray:
    return np.concatenate([params[name].ravel() for name in kernel.shapes()])


def unpack(kernel: Kernel, vector: np.ndarray) -> Params:
    params, at = {}, 0
    for name, shape in kernel.shapes().items():
        size = int(np.prod(shape))
        params[name] = vector[at:at + size].reshape(shape)
        at += size
    return params


def initial_weights(kernel: Kernel, seed: int = 42) -> np.ndarray:
    """Uniform in +-1/sqrt(width), the usual default for such layers."""
    rng = np.random.default_rng(seed)
    params = {}
    for name, shape in kernel.shapes().items():
        recurrent = isinstance(kernel, SequenceVAE) and name.split(".")[0] in ("enc", "dec")
        layer = name.split(".")[0]
        width = kernel.hidden_dim if recurrent else kernel.shapes()[f"{layer}.w"][0]
        bound = 1.0 / np.sqrt(width)
        params[name] = rng.uniform(-bound, bound, shape)
    return pack(kernel, params)


