"""Probabilistic automata inferred from sample strings by merging compatible prefix-tree states.

Strings are read as character classes (digit, hexadecimal letter, other small letter, capital, and each other
character by itself). The samples form a prefix tree with counts. In breadth-first order each state is merged with the
first settled one that it is compatible with: for no two states that would fold together, they and their successors,
may the samples lose more likelihood than the logarithm of all observations for each frequency that is saved. So a
prefix or a separator keeps states of its own, while stretches that follow one distribution become one state. How long
strings are is not told by the states but by a table of lengths.
"""

from __future__ import annotations

import math
from collections import Counter, deque

CLASS_SIZE = {"d": 10, "h": 6, "l": 20, "U": 26}
LOG_SIZE = {s: math.log(n) for s, n in CLASS_SIZE.items()}
_CLASS = str.maketrans({**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "U")})


def classes(value: str) -> str:
    return value.translate(_CLASS)


def _fit(counts: Counter) -> float:
    """The log-likelihood of what was counted under its own frequencies."""
    whole = sum(counts.values())
    return sum(n * math.log(n / whole) for n in counts.values() if n)


class Automaton:
    """A deterministic automaton with counts; `flat` ones have one state."""

    def __init__(self, samples: list[str], flat: bool = False):
        self.flat = flat
        self.passed: list[int] = [0]
        self.ended: list[int] = [0]
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[Counter] = [Counter()]
        self.lengths = Counter(map(len, samples))
        self.n = len(samples)
        for sample in samples:
            self._add(classes(sample))
        self._merge_all()

    def _add(self, symbols: str) -> None:
        at = 0
        self.passed[0] += 1
        for s in symbols:
            self.taken[at][s] += 1
            if s not in self.next[at]:
                self.next[at][s] = len(self.next)
                self.passed.append(0)
                self.ended.append(0)
                self.next.append({})
                self.taken.append(Counter())
            at = self.next[at][s]
            self.passed[at] += 1
        self.ended[at] += 1

    def _alike(self, into: int, tree: int, price: float) -> bool:
        """Whether no state of a tree differs from the state that it would fold into by more than a description saves."""
        if self.flat:
            return True
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            both = self.taken[a] + self.taken[b]
            saved = len(self.taken[a]) + len(self.taken[b]) - len(both)
            if _fit(self.taken[a]) + _fit(self.taken[b]) - _fit(both) > price * max(1, saved):
                return False
            todo.extend((self.next[a][s], child) for s, child in self.next[b].items() if s in self.next[a])
        return True

    def _fold(self, into: int, tree: int) -> list[tuple[int, str]]:
        """Adds the counts of a tree to a state and its successors; returns where parts of the tree were taken over whole."""
        todo, taken_over = [(into, tree)], []
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            self.taken[a].update(self.taken[b])
            for s, child in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], child))
                else:
                    self.next[a][s] = child
                    taken_over.append((a, s))
        return taken_over

    def _merge_all(self) -> None:
        settled, fringe = [0], deque((0, s) for s in sorted(self.next[0]))
        price = math.log(max(2, sum(sum(t.values()) for t in self.taken)))
        known = {0}
        while fringe:
            parent, symbol = fringe.popleft()
            state = self.next[parent][symbol]
            if state in known:
                continue
            for other in settled:
                if self._alike(other, state, price):
                    self.next[parent][symbol] = other
                    fringe.extend(sorted((a, s) for a, s in self._fold(other, state) if a in known))
                    break
            else:
                settled.append(state)
                known.add(state)
                fringe.extend((state, s) for s in sorted(self.next[state]))
        self.states = len(settled)
        self._log_steps(settled)

    def _log_steps(self, settled: list[int]) -> None:
        """Log-probability and next state for each state and class; `none` holds that of a class not seen there."""
        self.steps: dict[int, dict[str, tuple[float, int]]] = {}
        self.none: dict[int, float] = {}
        for at in settled:
            left = math.log(self.passed[at] - self.ended[at] + 0.01 * 40)
            self.steps[at] = {s: (math.log(n + 0.01) - left - math.log(CLASS_SIZE.get(s, 1)), self.next[at][s]) for s, n in self.taken[at].items()}
            self.none[at] = math.log(0.01) - left

    def log_likelihood(self, value: str, symbols: str | None = None) -> float:
        """Natural log-probability of the string: its classes, the characters within them, and its length."""
        at, total = 0, math.log((self.lengths[len(value)] + 0.05) / (self.n + 0.05 * 512))
        for s in classes(value) if symbols is None else symbols:
            step = self.steps[at].get(s)
            if step is None:
                total += self.none[at] - LOG_SIZE.get(s, 0.0)
            else:
                total += step[0]
                at = step[1]
        return total
