"""A character-level bidirectional LSTM with a linear-chain CRF over its tags, trained and decoded in numpy."""

from __future__ import annotations

import numpy as np

EMBEDDED, HIDDEN, BATCH, RATE, LARGEST_SLOPE = 16, 24, 32, 0.01, 5.0
PAD, SPACE, LOWER, UPPER, OTHER, SYMBOLS = 0, 96, 97, 98, 99, 100
FORBIDDEN = np.float32(-1e4)


def _table() -> np.ndarray:
    """Symbols of the code points below 0x3000: printable ASCII one each, all others by what they are."""
    at = np.full(0x3000, OTHER, np.uint8)
    for code in range(0x3000):
        c = chr(code)
        at[code] = code - 31 if 32 <= code < 127 else SPACE if c.isspace() else LOWER if c.islower() else UPPER if c.isupper() else OTHER
    return at


TABLE = _table()


def symbols(text: str) -> np.ndarray:
    """The symbol of every code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < len(TABLE), TABLE[np.minimum(codes, len(TABLE) - 1)], np.uint8(OTHER))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Tags: 0 outside, then for each kind k first (1 + 2k) and inside (2 + 2k)."""

    def __init__(self, kinds: int, seed: int = 13):
        draw = np.random.Generator(np.random.PCG64(seed))
        tags = 1 + 2 * kinds
        normal = lambda *shape: draw.normal(0, 0.5 / np.sqrt(shape[-2]), shape).astype(np.float32)
        bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
        bias[:, :, HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        self.tags = tags
        self.parts = {
            "embed": draw.normal(0, 0.3, (SYMBOLS, EMBEDDED)).astype(np.float32), "input": normal(2, EMBEDDED, 4 * HIDDEN), "again": normal(2, HIDDEN, 4 * HIDDEN), "bias": bias,
            "out": normal(2 * HIDDEN, tags), "out_bias": np.zeros(tags, np.float32), "steps": np.zeros((tags, tags), np.float32), "start": np.zeros(tags, np.float32), "stop": np.zeros(tags, np.float32),
        }
        self.allowed = np.zeros((tags, tags), np.float32)
        for to in range(2, tags, 2):  # inside only after first or inside of the same kind
            self.allowed[[i for i in range(tags) if i not in (to - 1, to)], to] = FORBIDDEN

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts.values()])

    def load(self, flat: np.ndarray) -> Tagger:
        at = 0
        for name, p in self.parts.items():
            self.parts[name] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return self

    # Windows are rows of symbols, padded behind; the second direction reads them reversed, padded behind too.

    @staticmethod
    def _both_ways(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows both ways, and for each place of a reversed window where it stands in the other one."""
        back = np.where(np.arange(ids.shape[1]) < lengths[:, None], lengths[:, None] - 1 - np.arange(ids.shape[1]), np.arange(ids.shape[1]))
        return np.stack([ids, np.take_along_axis(ids, back, 1)]), back

    def _recur(self, both: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (direction, window, place, unit), and what the way back needs."""
        p, (_, n, width) = self.parts, both.shape
        seen = p["embed"] @ p["input"] + p["bias"]  # what each symbol adds to the gates, by direction
        hidden, cell = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        out, kept = np.empty((2, n, width, HIDDEN), np.float32), []
        way = np.arange(2)[:, None]
        for t in range(width):
            gates = seen[way, both[:, :, t]]
            gates += hidden @ p["again"]
            soft = _sigmoid(gates[:, :, : 3 * HIDDEN])
            new = np.tanh(gates[:, :, 3 * HIDDEN :])
            i, f, o = soft[:, :, :HIDDEN], soft[:, :, HIDDEN : 2 * HIDDEN], soft[:, :, 2 * HIDDEN :]
            before = cell
            cell = f * cell + i * new
            bent = np.tanh(cell)
            if keep:
                kept.append((hidden, before, soft, new, bent))
            hidden = o * bent
            out[:, :, t] = hidden
        return out, kept

    def _emissions(self, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        both, back = self._both_ways(ids, lengths)
        hidden, kept = self._recur(both, keep)
        joined = np.concatenate([hidden[0], np.take_along_axis(hidden[1], back[:, :, None], 1)], 2)
        return joined @ self.parts["out"] + self.parts["out_bias"], (both, back, joined, kept)

    def _forward(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-sums of all ways up to each place, and over whole windows."""
        steps = self.parts["steps"] + self.allowed
        n, width, _ = scores.shape
        alpha = np.empty_like(scores)
        alpha[:, 0] = self.parts["start"] + scores[:, 0]
        for t in range(1, width):
            alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + steps, 1) + scores[:, t]
        return alpha, _log_sum(alpha[np.arange(n), lengths - 1] + self.parts["stop"], 1)

    def _backward(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-sums of all ways from each place on."""
        steps = self.parts["steps"] + self.allowed
        beta = np.zeros_like(scores)
        for t in range(scores.shape[1] - 1, -1, -1):
            if t + 1 < scores.shape[1]:
                beta[:, t] = _log_sum(steps + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((lengths - 1 == t)[:, None], self.parts["stop"], beta[:, t])
        return beta

    def loss_and_slopes(self, ids: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its slope for every parameter."""
        p, n, width = self.parts, len(ids), ids.shape[1]
        scores, (both, back, joined, kept) = self._emissions(ids, lengths, keep=True)
        alpha, whole = self._forward(scores, lengths)
        beta = self._backward(scores, lengths)
        rows, inside = np.arange(n), np.arange(width) < lengths[:, None]
        share = np.exp(np.minimum(alpha + beta - whole[:, None, None], 0)) * inside[:, :, None]
        steps = p["steps"] + self.allowed
        pairs = alpha[:, :-1, :, None] + steps + (scores + beta)[:, 1:, None, :] - whole[:, None, None, None]
        pair_share = (np.exp(np.minimum(pairs, 0)) * inside[:, 1:, None, None]).sum((0, 1))
        told = np.where(inside, np.take_along_axis(scores, tags[:, :, None], 2)[:, :, 0], 0).sum(1)
        moves = np.where(inside[:, 1:], steps[tags[:, :-1], tags[:, 1:]], 0).sum(1)
        last = tags[rows, lengths - 1]
        loss = float((whole - told - moves - p["start"][tags[:, 0]] - p["stop"][last]).mean())
        slopes = {}
        d_scores = share.copy()
        d_scores[rows[:, None], np.arange(width), tags] -= inside
        d_scores /= n
        seen = np.zeros_like(p["steps"])
        np.add.at(seen, (tags[:, :-1][inside[:, 1:]], tags[:, 1:][inside[:, 1:]]), 1)
        slopes["steps"] = (pair_share - seen) / n
        first, final = np.zeros_like(p["start"]), np.zeros_like(p["stop"])
        np.add.at(first, tags[:, 0], 1)
        np.add.at(final, last, 1)
        slopes["start"] = (share[:, 0].sum(0) - first) / n
        slopes["stop"] = (share[rows, lengths - 1].sum(0) - final) / n
        slopes["out"] = np.einsum("bth,btk->hk", joined, d_scores)
        slopes["out_bias"] = d_scores.sum((0, 1))
        d_joined = d_scores @ p["out"].T
        d_hidden = np.stack([d_joined[:, :, :HIDDEN], np.take_along_axis(d_joined[:, :, HIDDEN:], back[:, :, None], 1)])
        d_gates = np.empty((2, n, width, 4 * HIDDEN), np.float32)
        d_next, d_cell = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        slopes["again"] = np.zeros_like(p["again"])
        turned = p["again"].transpose(0, 2, 1)
        for t in range(width - 1, -1, -1):
            before, cell_before, soft, new, bent = kept[t]
            i, f, o = soft[:, :, :HIDDEN], soft[:, :, HIDDEN : 2 * HIDDEN], soft[:, :, 2 * HIDDEN :]
            d_h = d_hidden[:, :, t] + d_next
            d_cell = d_cell + d_h * o * (1 - bent * bent)
            g = d_gates[:, :, t]
            g[:, :, :HIDDEN] = d_cell * new * i * (1 - i)
            g[:, :, HIDDEN : 2 * HIDDEN] = d_cell * cell_before * f * (1 - f)
            g[:, :, 2 * HIDDEN : 3 * HIDDEN] = d_h * bent * o * (1 - o)
            g[:, :, 3 * HIDDEN :] = d_cell * i * (1 - new * new)
            slopes["again"] += before.transpose(0, 2, 1) @ g
            d_next = g @ turned
            d_cell = d_cell * f
        slopes["bias"] = d_gates.sum((1, 2))[:, None, :]
        by_symbol = np.zeros((2, SYMBOLS, 4 * HIDDEN), np.float32)
        for way in range(2):
            np.add.at(by_symbol[way], both[way].ravel(), d_gates[way].reshape(-1, 4 * HIDDEN))
        slopes["input"] = p["embed"].T @ by_symbol
        slopes["embed"] = (by_symbol @ p["input"].transpose(0, 2, 1)).sum(0)
        return loss, slopes

    def train(self, ids: np.ndarray, lengths: np.ndarray, tags: np.ndarray, rounds: int, seed: int = 13) -> float:
        """Steps of Adam over shuffled minibatches, at a rate that falls to a tenth; the loss of the last round."""
        draw = np.random.Generator(np.random.PCG64(seed))
        first = {k: np.zeros_like(v) for k, v in self.parts.items()}
        second = {k: np.zeros_like(v) for k, v in self.parts.items()}
        step, every, losses = 0, rounds * max(1, -(-len(ids) // BATCH)), []
        for _ in range(rounds):
            order, losses = draw.permutation(len(ids)), []
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                width = int(lengths[pick].max())
                loss, slopes = self.loss_and_slopes(ids[pick, :width], lengths[pick], tags[pick, :width])
                losses.append(loss)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
                rate, shrink = RATE * (1 - 0.9 * step / every), np.float32(min(1.0, LARGEST_SLOPE / max(size, 1e-9)))
                for k, g in slopes.items():
                    g = g * shrink
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.parts[k] = (self.parts[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses)) if losses else 0.0

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest tags of each window (Viterbi), and each place's share of all ways that agree with its tag (1 in
        windows that are outside throughout)."""
        scores, _ = self._emissions(ids, lengths)
        n, width, tags = scores.shape
        steps = self.parts["steps"] + self.allowed
        best, came = self.parts["start"] + scores[:, 0], np.zeros((n, width, tags), np.int8)
        ends = np.where((lengths == 1)[:, None], best + self.parts["stop"], FORBIDDEN * 100)
        for t in range(1, width):
            ways = best[:, :, None] + steps
            came[:, t] = ways.argmax(1)
            best = ways.max(1) + scores[:, t]
            ends = np.where((lengths - 1 == t)[:, None], best + self.parts["stop"], ends)
        out, at = np.zeros((n, width), np.int64), ends.argmax(1)
        for t in range(width - 1, -1, -1):
            at = np.where(t < lengths - 1, np.take_along_axis(came[:, min(t + 1, width - 1)], at[:, None], 1)[:, 0], at)
            out[:, t] = np.where(t < lengths, at, 0)
        share, told = np.ones((n, width), np.float32), np.flatnonzero(out.any(1))
        if len(told):
            scores, lengths = scores[told], lengths[told]
            alpha, whole = self._forward(scores, lengths)
            share[told] = np.exp(np.minimum(np.take_along_axis(alpha + self._backward(scores, lengths), out[told][:, :, None], 2)[:, :, 0] - whole[:, None], 0))
        return out, share
