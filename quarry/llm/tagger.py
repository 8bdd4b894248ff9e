"""A character tagger in numpy: bidirectional LSTM, linear layer, conditional random field."""
from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """``codes`` are (batch, time) character codes, ``tags`` (batch, time) tag numbers."""

    def __init__(self, symbols: int, tags: int, embed: int = 12, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        shape = {"embed": (symbols, embed), "out": (2 * hidden, tags), "out_b": (tags,), "pair": (tags, tags), "first": (tags,), "last": (tags,)}
        for d in ("f", "b"):
            shape |= {f"x_{d}": (embed, 4 * hidden), f"h_{d}": (hidden, 4 * hidden), f"bias_{d}": (4 * hidden,)}
        self.p = {k: (rng.standard_normal(s) * (0.3 if len(s) == 2 else 0.0)).astype(np.float32) for k, s in shape.items()}
        for d in ("f", "b"):
            self.p[f"bias_{d}"][hidden : 2 * hidden] = 1.0
        self.hidden = hidden

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Outputs (time, batch, hidden) in the order of ``x`` and what the gradient needs."""
        n, w = self.hidden, self.p[f"h_{d}"]
        pre = x @ self.p[f"x_{d}"] + self.p[f"bias_{d}"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out, kept = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)):
            z = pre[t] + h @ w
            s = _sigmoid(z[:, : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            before, c_before = h, c
            c = s[:, n : 2 * n] * c + s[:, :n] * g
            th = np.tanh(c)
            h = s[:, 2 * n :] * th
            out[t] = h
            kept.append((before, c_before, s, g, th))
        return out, kept

    def _lstm_back(self, x: np.ndarray, kept: list, dout: np.ndarray, d: str, grad: dict) -> np.ndarray:
        n, w = self.hidden, self.p[f"h_{d}"]
        dz_all = np.empty((*x.shape[:2], 4 * n), np.float32)
        dh = dc = np.zeros((x.shape[1], n), np.float32)
        dw = np.zeros_like(w)
        for t in range(len(x) - 1, -1, -1):
            before, c_before, s, g, th = kept[t]
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
            dc = dc * f
            dz_all[t] = dz
            dw += before.T @ dz
            dh = dz @ w.T
        grad[f"h_{d}"], grad[f"bias_{d}"] = dw, dz_all.sum((0, 1))
        flat = dz_all.reshape(-1, 4 * n)
        grad[f"x_{d}"] = x.reshape(-1, x.shape[2]).T @ flat
        return dz_all @ self.p[f"x_{d}"].T

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Scores (batch, time, tags)."""
        x = self.p["embed"][codes.T]
        both = np.concatenate([self._lstm(x, "f")[0], self._lstm(x[::-1], "b")[0][::-1]], 2)
        return (both @ self.p["out"] + self.p["out_b"]).transpose(1, 0, 2)

    def loss_and_gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        p, grad = self.p, {}
        x = p["embed"][codes.T]
        forward, kept_f = self._lstm(x, "f")
        backward, kept_b = self._lstm(x[::-1], "b")
        both = np.concatenate([forward, backward[::-1]], 2)
        e = both @ p["out"] + p["out_b"]
        time, size, k = e.shape
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[0] = p["first"] + e[0]
        for t in range(1, time):
            alpha[t] = e[t] + _logsumexp(alpha[t - 1][:, :, None] + p["pair"], 1)
        z = _logsumexp(alpha[-1] + p["last"], 1)
        beta[-1] = p["last"]
        for t in range(time - 2, -1, -1):
            beta[t] = _logsumexp(p["pair"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        share = np.exp(alpha + beta - z[:, None])
        pairs = np.zeros((k, k), np.float32)
        for t in range(1, time):
            pairs += np.exp(alpha[t - 1][:, :, None] + p["pair"] + (e[t] + beta[t] - z[:, None])[:, None, :]).sum(0)
        y = tags.T
        gold = np.eye(k, dtype=np.float32)[y]
        score = (e * gold).sum() + p["first"][y[0]].sum() + p["last"][y[-1]].sum() + p["pair"][y[:-1], y[1:]].sum()
        de = (share - gold) / size
        grad["pair"] = pairs / size
        np.subtract.at(grad["pair"], (y[:-1], y[1:]), 1 / size)
        grad["first"], grad["last"] = de[0].sum(0), de[-1].sum(0)
        grad["out"], grad["out_b"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, k), de.sum((0, 1))
        dboth = de @ p["out"].T
        n = self.hidden
        dx = self._lstm_back(x, kept_f, dboth[:, :, :n], "f", grad) + self._lstm_back(x[::-1], kept_b, dboth[::-1, :, n:], "b", grad)[::-1]
        grad["embed"] = np.zeros_like(p["embed"])
        np.add.at(grad["embed"], codes.T, dx)
        return float((z.sum() - score) / size), grad

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int = 160, batch: int = 48, rate: float = 0.02, seed: int = 11) -> "Tagger":
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            at = rng.choice(len(codes), min(batch, len(codes)), replace=False)
            _, grad = self.loss_and_gradient(codes[at], tags[at])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * (1 - step / (steps + 1))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = (self.p[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tag sequence for scores (time, tags) of any length."""
        pair, back = self.p["pair"], np.empty(e.shape, np.int32)
        best = self.p["first"] + e[0]
        for t in range(1, len(e)):
            all_ = best[:, None] + pair
            back[t] = all_.argmax(0)
            best = all_.max(0) + e[t]
        out = np.empty(len(e), np.int64)
        out[-1] = int((best + self.p["last"]).argmax())
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out
