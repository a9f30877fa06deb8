"""A linear-chain conditional random field in numpy: log-likelihood with gradients, and Viterbi decoding, over padded batches."""

from __future__ import annotations

import numpy as np


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis))


def gradients(emit: np.ndarray, trans: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood of the tags, and its gradients by emissions (n x t x k) and transitions (k x k)."""
    n, t, k = emit.shape
    alive = np.arange(t)[None] < lengths[:, None]
    a = np.empty_like(emit)
    a[:, 0] = emit[:, 0]
    for i in range(1, t):
        a[:, i] = np.where(alive[:, i, None], log_sum(a[:, i - 1, :, None] + trans[None], 1) + emit[:, i], a[:, i - 1])
    z = log_sum(a[:, -1], 1)
    b = np.zeros_like(emit)
    for i in range(t - 2, -1, -1):
        b[:, i] = np.where(alive[:, i + 1, None], log_sum(trans[None] + (emit[:, i + 1] + b[:, i + 1])[:, None], 2), b[:, i + 1])
    rows, places = np.arange(n)[:, None], np.arange(t)[None]
    gold = (emit[rows, places, tags] * alive).sum(1)
    pair_alive = alive[:, 1:]
    gold = gold + (trans[tags[:, :-1], tags[:, 1:]] * pair_alive).sum(1)
    d_emit = np.exp(a + b - z[:, None, None]) * alive[:, :, None]
    d_emit[rows, places, tags] -= alive
    d_trans = np.zeros_like(trans)
    for i in range(t - 1):
        pair = np.exp(a[:, i, :, None] + trans[None] + (emit[:, i + 1] + b[:, i + 1])[:, None] - z[:, None, None])
        d_trans += (pair * alive[:, i + 1, None, None]).sum(0)
    np.add.at(d_trans, (tags[:, :-1][pair_alive], tags[:, 1:][pair_alive]), -1.0)
    return float((z - gold).mean()), d_emit / n, d_trans / n


def viterbi(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best tags of each sequence (n x t; 0 beyond its length). Ties go to the smaller tag."""
    n, t, k = emit.shape
    best, back = emit[:, 0].copy(), np.zeros((n, t, k), np.int16)
    for i in range(1, t):
        paths = best[:, :, None] + trans[None]
        live = (i < lengths)[:, None]
        back[:, i] = np.where(live, paths.argmax(1), np.arange(k)[None])
        best = np.where(live, paths.max(1) + emit[:, i], best)
    tags, rows = np.zeros((n, t), np.int16), np.arange(n)
    at = best.argmax(1)
    for i in range(t - 1, -1, -1):
        tags[:, i] = np.where(i < lengths, at, 0)
        at = back[rows, i, at]
    return tags


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
