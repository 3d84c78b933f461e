"""A small bidirectional LSTM in numpy that labels every step of a sequence."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """``weights``: for each direction a matrix from (input, state, 1) to the
    four gates, and one from both states to the label's log odds."""

    def __init__(self, size: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size, self.hidden = size, hidden
        rows = size + hidden + 1
        self.weights = {
            name: rng.normal(0, 1 / np.sqrt(rows), (rows, 4 * hidden)).astype(np.float32)
            for name in ("forward", "backward")
        }
        for matrix in self.weights.values():
            matrix[-1, hidden:2 * hidden] = 1.0  # remember at first
        self.weights["out"] = rng.normal(0, 0.2, (2 * hidden + 1, 1)).astype(np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, name: str) -> tuple[np.ndarray, list]:
        """States (time, batch, hidden) of one direction, and what training needs."""
        times, batch, _ = x.shape
        matrix, h_size = self.weights[name], self.hidden
        h = np.zeros((batch, h_size), np.float32)
        c = np.zeros((batch, h_size), np.float32)
        out = np.zeros((times, batch, h_size), np.float32)
        inputs = x @ matrix[: self.size] + matrix[-1]
        kept = []
        order = range(times) if name == "forward" else range(times - 1, -1, -1)
        for t in order:
            gates = inputs[t] + h @ matrix[self.size:-1]
            i, f, o = (_sigmoid(gates[:, k * h_size:(k + 1) * h_size]) for k in range(3))
            g = np.tanh(gates[:, 3 * h_size:])
            fresh = f * c + i * g
            bent = np.tanh(fresh)
            m = mask[t][:, None]
            kept.append((t, h, c, i, f, o, g, bent, m))
            h = np.where(m, o * bent, h)
            c = np.where(m, fresh, c)
            out[t] = h
        return out, kept

    def log_odds(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log odds (time, batch) of the label; ``mask`` marks real steps."""
        both = [self._run(x, mask, name)[0] for name in ("forward", "backward")]
        return (np.concatenate(both, axis=2) @ self.weights["out"][:-1] + self.weights["out"][-1])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy of the real steps, and its gradients."""
        runs = {name: self._run(x, mask, name) for name in ("forward", "backward")}
        states = np.concatenate([runs[n][0] for n in ("forward", "backward")], axis=2)
        odds = (states @ self.weights["out"][:-1] + self.weights["out"][-1])[..., 0]
        p = _sigmoid(odds)
        n = max(mask.sum(), 1)
        loss = -(np.log(np.where(y, p, 1 - p) + 1e-9) * mask).sum() / n
        d_odds = ((p - y) * mask / n)[..., None].astype(np.float32)
        flat = states.reshape(-1, states.shape[2])
        out = {"out": np.vstack([flat.T @ d_odds.reshape(-1, 1), d_odds.sum().reshape(1, 1)])}
        d_states = d_odds @ self.weights["out"][:-1].T
        h_size = self.hidden
        for k, name in enumerate(("forward", "backward")):
            matrix = self.weights[name]
            grad = np.zeros_like(matrix)
            dh = np.zeros((x.shape[1], h_size), np.float32)
            dc = np.zeros_like(dh)
            deltas = np.zeros((*x.shape[:2], 4 * h_size), x.dtype)
            for t, h, c, i, f, o, g, bent, m in reversed(runs[name][1]):
                dh = dh + d_states[t][:, k * h_size:(k + 1) * h_size]
                d_fresh = np.where(m, dc + dh * o * (1 - bent ** 2), 0)
                d_gates = np.concatenate([
                    d_fresh * g * i * (1 - i), d_fresh * c * f * (1 - f),
                    np.where(m, dh * bent, 0) * o * (1 - o), d_fresh * i * (1 - g ** 2),
                ], axis=1)
                deltas[t] = d_gates
                grad[self.size:-1] += h.T @ d_gates
                grad[-1] += d_gates.sum(axis=0)
                dh = np.where(m, 0, dh) + d_gates @ matrix[self.size:-1].T
                dc = np.where(m, d_fresh * f, dc)
            grad[: self.size] = x.reshape(-1, self.size).T @ deltas.reshape(-1, 4 * h_size)
            out[name] = grad
        return float(loss), out

    def fit(
        self, sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int = 15,
        batch: int = 32, rate: float = 0.01, seed: int = 11,
    ) -> float:
        """Adam over shuffled batches; the loss of the last epoch."""
        rng = np.random.default_rng(seed)
        moments = {n: (np.zeros_like(w), np.zeros_like(w)) for n, w in self.weights.items()}
        step, loss = 0, 0.0
        by_length = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        batches = [by_length[i:i + batch] for i in range(0, len(by_length), batch)]
        for epoch in range(epochs):
            losses = []
            for k in rng.permutation(len(batches)):
                x, mask = padded([sequences[i] for i in batches[k]])
                y, _ = padded([labels[i][:, None] for i in batches[k]])
                value, grads = self.gradients(x, mask, y[..., 0] > 0.5)
                losses.append(value)
                step += 1
                for name, grad in grads.items():
                    first, second = moments[name]
                    grad = np.clip(grad, -1, 1)
                    first += 0.1 * (grad - first)
                    second += 0.001 * (grad ** 2 - second)
                    fall = rate * (1 - epoch / epochs)
                    self.weights[name] -= fall * (first / (1 - 0.9 ** step)) / (
                        np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch, size) and the mask of real steps."""
    longest = max(map(len, sequences))
    x = np.zeros((longest, len(sequences), sequences[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(sequences)), bool)
    for k, sequence in enumerate(sequences):
        x[: len(sequence), k] = sequence
        mask[: len(sequence), k] = True
    return x, mask
