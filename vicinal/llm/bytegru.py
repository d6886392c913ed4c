"""A bidirectional gated recurrent network over bytes: training by backpropagation through time, and batch inference. Plain numpy.

A text is cut into segments of ``SEGMENT`` bytes; a forward and a backward GRU run over each segment from a zero state, and the
two states at a position give that position's label probabilities. Arrays are laid out (features, batch), so that every gate is
a contiguous block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 10
SEGMENT = 96


@dataclass
class Net:
    """Weights of both directions (index 0 forward, 1 backward). Gates are ordered reset, update, candidate."""

    labels: list[str]
    table: np.ndarray  # (2, 3H, 256): input projection of each byte, biases included
    recur: np.ndarray  # (2, 3H, H)
    bias: np.ndarray  # (2, H): of the candidate's recurrent part
    out: np.ndarray  # (2, K, H)
    out_bias: np.ndarray  # (K,)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.bias, self.out, self.out_bias]


def new_net(labels: list[str], hidden: int, seed: int) -> Net:
    rng = np.random.default_rng(seed)
    k = len(labels)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Net(labels, draw(2, 3 * hidden, 256, scale=0.3), draw(2, 3 * hidden, hidden, scale=1 / np.sqrt(hidden)), np.zeros((2, hidden), np.float32), draw(2, k, hidden, scale=0.3), np.zeros(k, np.float32))


def _half_tanh(x: np.ndarray) -> np.ndarray:
    """Sigmoid in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def softmax(logits: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    logits -= logits.max(axis=0, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0, keepdims=True)
    return logits


def _step(net: Net, way: int, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state, reset and update gates, candidate, candidate's recurrent part) for one byte of each row."""
    n = len(h)
    a = net.table[way].take(x, axis=1)
    u = net.recur[way] @ h
    gates = a[: 2 * n]
    gates += u[: 2 * n]
    _half_tanh(gates)
    rec = u[2 * n :]
    rec += net.bias[way][:, None]
    cand = gates[:n] * rec
    cand += a[2 * n :]
    np.tanh(cand, out=cand)
    nxt = h - cand
    nxt *= gates[n:]
    nxt += cand
    return nxt, gates, cand, rec


def train(net: Net, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> list[float]:
    """Adam on the mean cross-entropy of every position's label, by backpropagation through time.

    ``x`` (sequences, time) bytes, ``y`` the label index of each sequence. Returns the loss of each step.
    """
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    losses = []
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        loss, grads = _gradients(net, x[pick].T, y[pick])
        losses.append(loss)
        lr = rate * min(1.0, 4 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.params(), grads, moments):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return losses


def _gradients(net: Net, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients for bytes x (time, batch)."""
    time, batch = x.shape
    n, k = net.recur.shape[2], len(net.labels)
    grads = [np.zeros_like(p) for p in net.params()]
    kept: list[list[tuple]] = [[], []]
    states = np.zeros((2, time, n, batch), np.float32)
    for way in (0, 1):
        h = np.zeros((n, batch), np.float32)
        for t in range(time) if way == 0 else range(time - 1, -1, -1):
            before = h
            h, gates, cand, rec = _step(net, way, x[t], h)
            kept[way].append((t, before, gates, cand, rec))
            states[way, t] = h
    logits = np.einsum("kn,tnb->ktb", net.out[0], states[0], optimize=True) + np.einsum("kn,tnb->ktb", net.out[1], states[1], optimize=True) + net.out_bias[:, None, None]
    p = softmax(logits)
    loss = float(-np.log(p[y, :, np.arange(batch)] + 1e-9).mean())
    p[y, :, np.arange(batch)] -= 1
    p /= time * batch
    grads[4] += p.sum(axis=(1, 2))
    for way in (0, 1):
        grads[3][way] = np.einsum("ktb,tnb->kn", p, states[way], optimize=True)
        down = np.einsum("kn,ktb->tnb", net.out[way], p, optimize=True)
        dh = np.zeros((n, batch), np.float32)
        into = np.empty((time, batch, 3 * n), p.dtype)
        for t, before, gates, cand, rec in reversed(kept[way]):
            dh = dh + down[t]
            r, z = gates[:n], gates[n:]
            dc = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (before - cand) * z * (1 - z)
            dr = dc * rec * r * (1 - r)
            da = np.concatenate([dr, dz, dc])
            du = np.concatenate([dr, dz, dc * r])
            grads[1][way] += du @ before.T
            grads[2][way] += du[2 * n :].sum(axis=1)
            into[t] = da.T
            dh = dh * z + net.recur[way].T @ du
        order = np.argsort(x, axis=None, kind="stable")
        seen, first = np.unique(x.reshape(-1)[order], return_index=True)
        grads[0][way][:, seen] = np.add.reduceat(into.reshape(-1, 3 * n)[order], first, axis=0).T
    return loss, grads


def segments_of(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes (segments, size), used length of each, row of each) of byte texts raw[offsets[i] : offsets[i + 1]]."""
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    used = np.minimum(size, lengths[row] - place * size)
    begin = offsets[:-1][row] + place * size
    at = begin[:, None] + np.arange(size)
    x = raw[np.minimum(at, max(len(raw) - 1, 0))] if len(row) else np.empty((0, size), np.uint8)
    return x, used, row


def position_probabilities(net: Net, x: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Sum over the used positions of each segment's label probabilities: (labels, segments)."""
    count, size = x.shape
    n, k = net.recur.shape[2], len(net.labels)
    xt = np.ascontiguousarray(x.T)
    full = int(used.min(initial=size)) if count else 0
    forward = np.empty((size, k, count), np.float32)
    h = np.zeros((n, count), np.float32)
    for t in range(size):
        h = _step(net, 0, xt[t], h)[0]
        np.matmul(net.out[0], h, out=forward[t])
    h = np.zeros((n, count), np.float32)
    total = np.zeros((k, count), np.float32)
    for t in range(size - 1, -1, -1):
        h = _step(net, 1, xt[t], h)[0]
        if t >= full:
            inside = (used > t).astype(np.float32)
            h *= inside
        logits = net.out[1] @ h
        logits += forward[t]
        logits += net.out_bias[:, None]
        p = softmax(logits)
        if t >= full:
            p *= inside
        total += p
    return total


def pool(net: Net, raw: np.ndarray, offsets: np.ndarray, size: int = SEGMENT, batch: int = 4096) -> np.ndarray:
    """(rows, labels): mean over all positions of each text's label probabilities; zeros for an empty text."""
    x, used, row = segments_of(raw, offsets, size)
    order = np.argsort(-used, kind="stable")
    sums = np.zeros((len(offsets) - 1, len(net.labels)))
    for at in range(0, len(order), batch):
        part = order[at : at + batch]
        np.add.at(sums, row[part], position_probabilities(net, x[part], used[part]).T)
    return sums / np.maximum(1, np.diff(offsets))[:, None]
