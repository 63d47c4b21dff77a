"""A byte convolutional network in numpy: filters of several widths, max pooling over a window, a dense layer, softmax.

A filter of width w is w tables of one weight per byte value, which is a convolution over one-hot bytes without
building them. Training is Adam with gradients that flow to the bytes under each maximum. For scoring, neighbouring tables
are merged into one table over byte pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

PAD = 0


def windows_of(offsets: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of windows that cover every byte of every row; an empty row has none."""
    sizes = np.diff(offsets)
    n = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - length) // stride)), 0)
    row = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][row] + k * stride
    return row, start, np.minimum(start + length, offsets[1:][row])


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """The windows as rows of ``length`` bytes, padded."""
    at = start[:, None] + np.arange(length)
    x = data[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.zeros(at.shape, np.uint8)
    x[at >= end[:, None]] = PAD
    return x


@dataclass
class Net:
    widths: tuple[int, ...]
    tables: list[np.ndarray]  # by width: (width, 256, filters)
    dense: np.ndarray
    bias: np.ndarray
    classes: list
    pairs: list = field(default_factory=list, repr=False)

    @classmethod
    def new(cls, classes: list, widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, seed: int = 0) -> Net:
        rng = np.random.default_rng(seed)
        tables = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths]
        for t in tables:
            t[:, PAD] = 0
        hidden = filters * len(widths)
        return cls(tuple(widths), tables, rng.normal(0, hidden ** -0.5, (hidden, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32), list(classes))

    def _maps(self, x: np.ndarray):
        for w, t in zip(self.widths, self.tables):
            n = x.shape[1] - w + 1
            z = t[0][x[:, :n]]
            for j in range(1, w):
                z += t[j][x[:, j: n + j]]
            yield w, t, z

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 3e-3, decay: float = 1e-5, seed: int = 0,
            least_steps: int = 1500) -> Net:
        """Minimise the cross entropy of windows x (bytes) and class numbers y; small samples are seen more often."""
        rng = np.random.default_rng(seed)
        epochs = max(epochs, -(-least_steps // -(-len(x) // batch)))
        params = [*self.tables, self.dense, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        total = max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at: at + batch]
                xb, pooled, places = x[some], [], []
                for _, _, z in self._maps(xb):
                    p = z.argmax(axis=1)
                    places.append(p)
                    pooled.append(np.take_along_axis(z, p[:, None], axis=1)[:, 0])
                h = np.concatenate(pooled, axis=1)
                a = np.maximum(h, 0)
                logit = a @ self.dense + self.bias
                prob = np.exp(logit - logit.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                prob[np.arange(len(some)), y[some]] -= 1
                prob /= len(some)
                back = (prob @ self.dense.T) * (h > 0)
                grads, f = [], 0
                for (w, t), p in zip(zip(self.widths, self.tables), places):
                    k = t.shape[2]
                    d = back[:, f: f + k]
                    g = np.empty_like(t)
                    for j in range(w):
                        under = np.take_along_axis(xb, p + j, axis=1).astype(np.int64)
                        g[j] = np.bincount((under * k + np.arange(k)).ravel(), d.ravel(), minlength=256 * k).reshape(256, k)
                    g[:, PAD] = 0
                    grads.append(g)
                    f += k
                grads += [a.T @ prob, prob.sum(axis=0)]
                step += 1
                now = rate * (1 - step / (total + 1))
                for i, (p, g) in enumerate(zip(params, grads)):
                    g = g + decay * p
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p -= (now / (1 - 0.9 ** step)) * m[i] / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def _paired(self) -> list:
        """By width: tables over the byte pairs at even offsets, and a table of single bytes for an odd last offset."""
        if not self.pairs:
            self.pairs = [([(t[j][:, None] + t[j + 1][None, :]).reshape(65536, -1) for j in range(0, w - 1, 2)], t[w - 1] if w % 2 else None)
                          for w, t in zip(self.widths, self.tables)]
        return self.pairs

    def log_probabilities(self, x: np.ndarray, batch: int = 128) -> np.ndarray:
        """Log softmax of every window."""
        out = np.empty((len(x), len(self.classes)))
        for at in range(0, len(x), batch):
            xb = x[at: at + batch]
            pair = (xb[:, :-1].astype(np.intp) << 8) | xb[:, 1:]
            pooled = []
            for w, (double, single) in zip(self.widths, self._paired()):
                n = xb.shape[1] - w + 1
                z = double[0][pair[:, :n]]
                for i, t in enumerate(double[1:], 1):
                    z += t[pair[:, 2 * i: 2 * i + n]]
                if single is not None:
                    z += single[xb[:, w - 1: w - 1 + n]]
                pooled.append(z.max(axis=1))
            logit = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.bias
            logit -= logit.max(axis=1, keepdims=True)
            out[at: at + batch] = logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))
        return out

    def document_scores(self, data: np.ndarray, offsets: np.ndarray, length: int, stride: int) -> np.ndarray:
        """Probabilities of each row: the mean log probability of its windows, weighted by their bytes, normalised; a row
        without bytes gets the probabilities of a window of padding."""
        row, start, end = windows_of(offsets, length, stride)
        rows, k = len(offsets) - 1, len(self.classes)
        total, weight = np.zeros((rows, k)), np.zeros(rows)
        for at in range(0, len(row), 1024):
            part = slice(at, at + 1024)
            lp = self.log_probabilities(cut(data, start[part], end[part], length))
            size = (end[part] - start[part]).astype(float)
            weight += np.bincount(row[part], size, minlength=rows)
            for c in range(k):
                total[:, c] += np.bincount(row[part], size * lp[:, c], minlength=rows)
        empty = weight == 0
        mean = total / np.where(empty, 1, weight)[:, None]
        if empty.any():
            mean[empty] = self.log_probabilities(np.full((1, length), PAD, np.uint8))[0]
        mean = np.exp(mean - mean.max(axis=1, keepdims=True))
        return mean / mean.sum(axis=1, keepdims=True)
