"""Tails of Student's t and chi-square, by continued fractions; used on the driver for merged figures only."""

from __future__ import annotations

import math

TINY, STEPS, CLOSE = 1e-300, 500, 1e-15


def _fraction(step) -> float:
    """Lentz's evaluation of b0 + a1/(b1 + a2/(b2 + ...)); step(i) gives (a_i, b_i), a_0 unused."""
    value = step(0)[1] or TINY
    c, d = value, 0.0
    for i in range(1, STEPS):
        a, b = step(i)
        d = 1 / ((b + a * d) or TINY)
        c = (b + a / c) or TINY
        value *= c * d
        if abs(c * d - 1) < CLOSE:
            break
    return value


def beta_regularised(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def step(i: int) -> tuple[float, float]:
        if i == 0:
            return 0.0, 1.0
        m, odd = divmod(i - 1, 2)
        if odd:
            m += 1
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return front / _fraction(step)


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|)."""
    return beta_regularised(dof / (dof + t * t), dof / 2, 0.5)


def t_quantile(p: float, dof: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, dof) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, dof) / 2 < p else (low, mid)
    return (low + high) / 2


def chi_square_tail(x: float, dof: float) -> float:
    """P(X >= x)."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    return scale / _fraction(lambda i: (-i * (i - a), x + 2 * i + 1 - a))
