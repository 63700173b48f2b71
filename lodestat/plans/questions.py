"""Question cards: what can be asked with the variables that somebody has chosen, and the analyses that answer it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

NUMBER, CATEGORY = "number", "category"


@dataclass(frozen=True)
class Question:
    """A question, the kinds of variables that it needs, and whether it needs groups."""

    key: str
    needs: tuple[str, ...]
    groups: bool
    asks: Callable[[list[str]], list[dict]]

    def fits(self, kinds: Counter, has_groups: bool) -> bool:
        return (has_groups or not self.groups) and not Counter(self.needs) - kinds


QUESTIONS = (
    Question("summary", (), False, lambda v: [{"kind": "describe", "vars": v}]),
    Question("spread", (NUMBER,), False, lambda v: [{"kind": "describe", "vars": v[:1]}, {"kind": "histogram", "var": v[0]}]),
    Question("shares", (CATEGORY,), False, lambda v: [{"kind": "frequency", "vars": v[:1]}]),
    Question("together", (NUMBER, NUMBER), False, lambda v: [{"kind": "correlation", "vars": v[:2]}]),
    Question("table", (CATEGORY, CATEGORY), False, lambda v: [{"kind": "crosstab", "row": v[0], "col": v[1]}]),
    Question("groups", (), True, lambda v: [{"kind": "compare_groups", "vars": v}]),
    Question("course", (NUMBER,), False, lambda v: [{"kind": "over_time", "var": v[0], "bin_days": 7, "range_days": [0, 90]}]),
    Question("gaps", (), False, lambda v: [{"kind": "completeness"}]),
)


def kinds_of(types: dict[str, str]) -> dict[str, str]:
    """number or category for each variable of a frame, by its type."""
    return {name: CATEGORY if kind in ("string", "boolean") else NUMBER for name, kind in types.items()}


def applicable(kinds: dict[str, str], has_groups: bool = False) -> list[str]:
    """The questions that the chosen variables can answer, in the order of the cards."""
    held = Counter(kinds.values())
    return [q.key for q in QUESTIONS if q.fits(held, has_groups)]


def analyses(question: str, kinds: dict[str, str], has_groups: bool = False) -> list[dict]:
    """The analyses of a question over variables of the kinds that it needs; an error if it cannot be answered."""
    card = next((q for q in QUESTIONS if q.key == question), None)
    if card is None or not card.fits(Counter(kinds.values()), has_groups):
        raise ValueError(f"{question} cannot be asked of these variables")
    return card.asks([name for name, kind in kinds.items() if not card.needs or kind in card.needs])
