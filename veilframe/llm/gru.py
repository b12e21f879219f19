"""A bidirectional gated recurrent network in numpy: forward, backpropagation through time, Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, B, H) of a network with inputs ``x`` (T, B, 3H: update, reset, candidate) and recurrence ``u`` (H, 3H).

    Where ``mask`` (T, B) is 0 the state stays. ``keep`` collects what ``backward`` needs.
    """
    steps, batch, h3 = x.shape
    n = h3 // 3
    h = np.zeros((batch, n), x.dtype)
    out = np.empty((steps, batch, n), x.dtype)
    for t in range(steps):
        a = h @ u
        gates = x[t, :, : 2 * n] + a[:, : 2 * n]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(x[t, :, 2 * n :] + r * a[:, 2 * n :])
        new = c + z * (h - c)
        m = mask[t]
        if not m.all():
            new = np.where(m[:, None] > 0, new, h)
        if keep is not None:
            keep.append((h, z.copy(), r.copy(), c, a[:, 2 * n :].copy()))
        h = out[t] = new
    return out


def read(table: np.ndarray, u: np.ndarray, code: np.ndarray) -> np.ndarray:
    """What ``forward`` gives for inputs ``table[code]`` (T, B) without a mask: nothing is kept, inputs are looked up step by step."""
    steps, batch = code.shape
    n = u.shape[0]
    h, gates, c = (np.zeros((batch, k), table.dtype) for k in (n, 2 * n, n))
    out = np.empty((steps, batch, n), table.dtype)
    half = np.concatenate([np.full(2 * n, 0.5, table.dtype), np.ones(n, table.dtype)])
    table, u = table * half, u * half  # a logistic is half a tanh of half its argument, and a half
    for t in range(steps):
        x, a = table[code[t]], h @ u
        np.add(x[:, : 2 * n], a[:, : 2 * n], out=gates)
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        np.multiply(gates[:, n:], a[:, 2 * n :], out=c)
        c += x[:, 2 * n :]
        np.tanh(c, out=c)
        h = h - c
        h *= gates[:, :n]
        h += c
        out[t] = h
    return out


def backward(d: np.ndarray, u: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (of x, of u) from gradients ``d`` (T, B, H) of the states."""
    steps, batch, n = d.shape
    dx, du, dh = np.zeros((steps, batch, 3 * n), d.dtype), np.zeros_like(u), np.zeros((batch, n), d.dtype)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, ac = kept[t]
        m = mask[t][:, None]
        total = dh + d[t]
        dn = total * m
        dz = dn * (h - c) * z * (1 - z)
        dc = dn * (1 - z) * (1 - c * c)
        dr = dc * ac * r * (1 - r)
        da = np.concatenate([dz, dr, dc * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dc], axis=1)
        du += h.T @ da
        dh = dn * z + da @ u.T + total * (1 - m)
    return dx, du


def both(xf: np.ndarray, xb: np.ndarray, uf: np.ndarray, ub: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
    """States (T, B, 2H) of a network that reads forwards and one that reads backwards."""
    f = forward(xf, uf, mask, keep[0] if keep else None)
    b = forward(xb[::-1], ub, mask[::-1], keep[1] if keep else None)[::-1]
    return np.concatenate([f, b], axis=2)


def both_back(d: np.ndarray, uf: np.ndarray, ub: np.ndarray, mask: np.ndarray, keep: tuple[list, list]) -> tuple:
    """Gradients of xf, xb, uf, ub."""
    n = d.shape[2] // 2
    dxf, duf = backward(d[:, :, :n], uf, mask, keep[0])
    dxb, dub = backward(d[::-1, :, n:], ub, mask[::-1], keep[1])
    return dxf, dxb[::-1], duf, dub


class Adam:
    """Adam over a dictionary of arrays, with clipped gradients."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        scale = min(1.0, clip / (norm + 1e-12))
        for k, x in g.items():
            x = x * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(self.p[k].dtype)
