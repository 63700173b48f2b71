"""A log-bilinear model over word classes in numpy: noise-contrastive training and normalised scores."""

from __future__ import annotations

import numpy as np

#: Classes of context words before a token, their dimensions, noise draws shared by a minibatch, and training steps.
CONTEXT, DIMENSIONS, NOISE, BATCH, RATE = 2, 16, 128, 1024, 0.04


def _sums(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows by the class that they belong to."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    firsts = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[sorted_at[firsts]] = np.add.reduceat(rows[order], firsts, axis=0)
    return out


class LogBilinear:
    """Class representations as context (r) and as target (q), a bias each, and a weight for each context place."""

    def __init__(self, unigram: np.ndarray, seed: int = 5):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.size = len(unigram)
        self.noise = (unigram / unigram.sum()).astype(np.float64)
        self.log_noise = np.log(self.noise * NOISE).astype(np.float32)
        shape = (self.size, DIMENSIONS)
        self.parts = [draw.normal(0, 0.1, shape).astype(np.float32), draw.normal(0, 0.1, shape).astype(np.float32), np.log(self.noise).astype(np.float32)[:, None], np.ones((CONTEXT, DIMENSIONS), np.float32)]
        self._norms: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_norms": None}

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for i, p in enumerate(self.parts):
            self.parts[i] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        self._norms = None

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        r, places = self.parts[0], self.parts[3]
        return sum(r[contexts[:, k]] * places[k] for k in range(CONTEXT))

    def train(self, contexts: np.ndarray, targets: np.ndarray, draw: np.random.Generator, squares: list[np.ndarray], rate: float = RATE) -> None:
        """One pass of AdaGrad steps over the tokens; squares are the sums of squared gradients so far."""
        r, q, b, places = self.parts
        self._norms = None
        noises = np.searchsorted(np.cumsum(self.noise), draw.random((-(-len(targets) // BATCH), NOISE)), "right").clip(max=self.size - 1)
        for step, at in enumerate(range(0, len(targets), BATCH)):
            c, w, x = contexts[at : at + BATCH], targets[at : at + BATCH], noises[step]
            n = len(w)
            hat = self.predicted(c)
            qw, qx = q[w], q[x]
            real = np.einsum("ij,ij->i", hat, qw) + b[w, 0] - self.log_noise[w]
            fake = hat @ qx.T + b[x, 0] - self.log_noise[x]
            up = 1 / (1 + np.exp(np.clip(real, -30, 30)))
            down = -1 / (1 + np.exp(np.clip(-fake, -30, 30)))
            d_hat = up[:, None] * qw + down @ qx
            d_q = _sums(up[:, None] * hat, w, self.size) + _sums(down.T @ hat, x, self.size)
            d_b = _sums(up[:, None], w, self.size) + _sums(down.sum(0)[:, None], x, self.size)
            d_r = sum(_sums(d_hat * places[k], c[:, k], self.size) for k in range(CONTEXT))
            d_places = np.stack([(d_hat * r[c[:, k]]).sum(0) for k in range(CONTEXT)])
            for part, grad, square in zip(self.parts, (d_r, d_q, d_b, d_places), squares):
                grad /= np.float32(n)
                square += grad * grad
                part += rate * grad / (np.sqrt(square) + np.float32(1e-6))

    def norms(self) -> np.ndarray:
        """For each pair of context classes the log of the sum over all targets.

        A target's score is a sum over the context places, so the sums for all pairs are one product of two matrices.
        """
        if self._norms is None:
            r, q, b, places = self.parts
            first, second = (r * places[0]) @ q.T + b[:, 0], (r * places[1]) @ q.T
            tops = first.max(1), second.max(1)
            whole = np.exp(first - tops[0][:, None]) @ np.exp(second - tops[1][:, None]).T
            self._norms = np.log(np.maximum(whole, np.float32(1e-37))) + tops[0][:, None] + tops[1]
        return self._norms

    def log10(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token."""
        q, b, norms = self.parts[1], self.parts[2][:, 0], self.norms()
        out = np.empty(len(targets), np.float64)
        for at in range(0, len(targets), 1 << 16):
            c, w = contexts[at : at + (1 << 16)], targets[at : at + (1 << 16)]
            out[at : at + (1 << 16)] = np.einsum("ij,ij->i", self.predicted(c), q[w]) + b[w] - norms[c[:, 0], c[:, 1]]
        return out / np.log(10)
