"""Tail probabilities of the drift tests. Called once per compared column, on finished statistics."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def kolmogorov_two_sided(d: float, n_left: int, n_right: int) -> float:
    """Limit law of the two-sample Kolmogorov-Smirnov distance (Smirnov 1948)."""
    scaled = d * math.sqrt(n_left * n_right / (n_left + n_right))
    if scaled < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * (k * scaled) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


def chi_square_upper(x: float, dof: int) -> float:
    """P(X >= x) of a chi-square variable: the regularised upper incomplete gamma function."""
    if x <= 0 or dof <= 0:
        return 1.0
    shape, point = dof / 2.0, x / 2.0
    scale = math.exp(shape * math.log(point) - point - math.lgamma(shape))
    if point < shape + 1.0:
        # Power series of the lower function.
        term = total = 1.0 / shape
        step = shape
        while abs(term) > abs(total) * 1e-15:
            step += 1.0
            term *= point / step
            total += term
        return max(0.0, 1.0 - scale * total)
    # Continued fraction of the upper function, evaluated by the recurrence of its convergents.
    tiny = 1e-300
    b = point + 1.0 - shape
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for i in range(1, 100_000):
        a = -i * (i - shape)
        b += 2.0
        d = 1.0 / (a * d + b or tiny)
        c = b + a / c or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return min(1.0, scale * value)
