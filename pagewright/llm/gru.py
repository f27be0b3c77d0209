"""Bidirectional gated recurrent networks in numpy: many sequences side by side, features by rows, trained by
backpropagation through time.

Gates use the hard sigmoid clip(x / 4 + 1 / 2, 0, 1), which costs a fraction of the exponential one. Step t of a
sequence: z, r = gates(W x + U h + b); n = tanh(Wn x + bn + r * Un h); h = h + z * (n - h).
"""

from __future__ import annotations

import numpy as np


def init(hidden: int, rng: np.random.Generator) -> np.ndarray:
    """Recurrent weights (3 * hidden, hidden), orthogonal by gate."""
    return np.concatenate([np.linalg.qr(rng.standard_normal((hidden, hidden)))[0] for _ in range(3)]).astype(np.float32)


def forward(u: np.ndarray, inputs, steps: int, width: int, mask: np.ndarray | None = None, keep: bool = False):
    """Hidden states (steps, hidden, width). ``inputs(t)`` gives the projected input (3 * hidden, width) of a step, which
    may be overwritten; mask (steps, width) is 0 where a sequence is padded, and the state stays 0 there."""
    hidden = u.shape[1]
    h = np.zeros((hidden, width), np.float32)
    states = np.empty((steps, hidden, width), np.float32)
    rec = np.empty((3 * hidden, width), np.float32)
    cache = []
    for t in range(steps):
        g = inputs(t)
        np.matmul(u, h, out=rec)
        gates = g[: 2 * hidden]
        gates += rec[: 2 * hidden]
        if keep:
            raw = gates.copy()
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        n = gates[:hidden] * rec[2 * hidden :]
        n += g[2 * hidden :]
        np.tanh(n, out=n)
        if keep:
            cache.append((h, gates.copy(), n.copy(), rec[2 * hidden :].copy(), np.abs(raw) < 2))
        n -= h
        n *= gates[hidden:]
        h = h + n
        if mask is not None:
            h *= mask[t]
        states[t] = h
    return (states, cache) if keep else states


def backward(u: np.ndarray, cache: list, grad: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the recurrent weights and of the projected inputs (steps, 3 * hidden, width) from those of the states."""
    hidden = u.shape[1]
    du = np.zeros_like(u)
    dg = np.empty((len(cache), 3 * hidden, grad.shape[2]), np.float32)
    dh = np.zeros(grad.shape[1:], np.float32)
    for t in range(len(cache) - 1, -1, -1):
        h, gates, n, un, linear = cache[t]
        dh = dh + grad[t]
        if mask is not None:
            dh = dh * mask[t]
        r, z = gates[:hidden], gates[hidden:]
        dn = dh * z * (1 - n * n)
        dz = dh * (n - h)
        dr = dn * un
        dgate = np.concatenate([dr, dz]) * 0.25 * linear
        drec = np.concatenate([dgate, dn * r])
        dg[t, : 2 * hidden], dg[t, 2 * hidden :] = dgate, dn
        du += drec @ h.T
        dh = dh * (1 - z) + u.T @ drec
    return du, dg


class Adam:
    """Adam steps on a dict of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (size + 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * ((self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8) + self.decay * self.params[k])
