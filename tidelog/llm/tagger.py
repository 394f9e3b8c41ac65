"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters are printable ASCII, other letters, other characters, and what lies outside of the text.
LETTER, OTHER, OUTSIDE, CHARACTERS = 95, 96, 97, 98
EMBED, HIDDEN = 10, 16


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= 32) & (points < 127), points - 32, np.where(points >= 0xC0, LETTER, OTHER))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Tags windows of characters with one of ``tags`` labels; parameters are a few thousand numbers."""

    def __init__(self, tags: int, allowed: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        gate = lambda a, b: (rng.normal(0, 1, (a, b)) / np.sqrt(a)).astype(np.float32)
        self.allowed = allowed
        self.p = {"embed": rng.normal(0, 0.3, (CHARACTERS, EMBED)).astype(np.float32), "out": gate(2 * HIDDEN, tags), "out_b": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32), "start": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": gate(EMBED, 4 * HIDDEN), f"{d}h": gate(HIDDEN, 4 * HIDDEN), f"{d}b": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"{d}b"][HIDDEN : 2 * HIDDEN] = 1

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, hidden) of one direction; ``x`` is in that direction's order."""
        n, h = HIDDEN, np.zeros((x.shape[1], HIDDEN), np.float32)
        c, out = h, np.empty((*x.shape[:2], HIDDEN), np.float32)
        inputs = x @ self.p[f"{d}x"] + self.p[f"{d}b"]
        for t in range(len(x)):
            z = inputs[t] + h @ self.p[f"{d}h"]
            i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 3 * n :]), np.tanh(z[:, 2 * n : 3 * n])
            before, c = c, f * c + i * g
            s = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, g, o, s))
            h = o * s
            out[t] = h
        return out

    def _back(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        n, dh, dc = HIDDEN, 0, 0
        dz = np.empty((*x.shape[:2], 4 * n), np.float32)
        wh = self.p[f"{d}h"].T
        for t in range(len(x) - 1, -1, -1):
            h, before, i, f, g, o, s = kept[t]
            dh = dout[t] + dh
            dc = dh * o * (1 - s * s) + dc
            dz[t, :, :n], dz[t, :, n : 2 * n] = dc * g * i * (1 - i), dc * before * f * (1 - f)
            dz[t, :, 2 * n : 3 * n], dz[t, :, 3 * n :] = dc * i * (1 - g * g), dh * s * o * (1 - o)
            dc = dc * f
            dh = dz[t] @ wh
        flat = dz.reshape(-1, 4 * n)
        grad[f"{d}x"] = x.reshape(-1, EMBED).T @ flat
        grad[f"{d}h"] = np.concatenate([k[0] for k in kept]).T @ flat
        grad[f"{d}b"] = flat.sum(0)
        return dz @ self.p[f"{d}x"].T

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        x = self.p["embed"][windows.T]
        h = np.concatenate([self._run(x, "f"), self._run(x[::-1], "b")[::-1]], axis=2)
        return h @ self.p["out"] + self.p["out_b"]

    def decode(self, windows: np.ndarray) -> np.ndarray:
        """The best labels (batch, time) of windows of codes (batch, time)."""
        e = self.emissions(windows)
        trans = np.where(self.allowed, self.p["trans"], -1e9)
        best, back = e[0] + self.p["start"], []
        for t in range(1, len(e)):
            each = best[:, :, None] + trans
            back.append(each.argmax(1))
            best = each.max(1) + e[t]
        path = [best.argmax(1)]
        for b in reversed(back):
            path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
        return np.stack(path[::-1], 1)

    def step(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch."""
        x, y = self.p["embed"][windows.T], labels.T
        kept_f, kept_b = [], []
        h = np.concatenate([self._run(x, "f", kept_f), self._run(x[::-1], "b", kept_b)[::-1]], axis=2)
        e = h @ self.p["out"] + self.p["out_b"]
        steps, batch, tags = e.shape
        trans = np.where(self.allowed, self.p["trans"], -1e9)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.p["start"]
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        marginal = np.exp(alpha + beta - z[:, None])
        right = np.zeros_like(e)
        np.put_along_axis(right, y[:, :, None], 1, 2)
        pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        counts = np.zeros((tags, tags), np.float32)
        np.add.at(counts, (y[:-1].ravel(), y[1:].ravel()), 1)
        score = (e * right).sum() + (trans * counts).sum() + self.p["start"][y[0]].sum()
        de = (marginal - right).astype(np.float32) / batch
        grad = {"trans": np.where(self.allowed, pair - counts, 0) / batch, "start": de[0].sum(0), "out_b": de.sum((0, 1)), "out": h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, tags)}
        dh = de @ self.p["out"].T
        dx = self._back(x, "f", kept_f, dh[:, :, :HIDDEN], grad)
        dx = dx + self._back(x[::-1], "b", kept_b, dh[::-1, :, HIDDEN:], grad)[::-1]
        grad["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grad["embed"], windows.T.ravel(), dx.reshape(-1, EMBED))
        return float((z.sum() - score) / batch), grad

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 5) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch."""
        rng, losses, k = np.random.default_rng(seed), [], 0
        m, v = ({n: np.zeros_like(x) for n, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            total = []
            for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
                loss, grad = self.step(windows[at], labels[at])
                total.append(loss)
                k += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for n, g in grad.items():
                    g = g * min(1, 5 / (norm + 1e-9))
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.999 * v[n] + 0.001 * g * g
                    self.p[n] -= (rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses
