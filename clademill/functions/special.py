"""Special functions that numpy lacks, for scalars and arrays."""

from __future__ import annotations

import math

import numpy as np

lgamma = np.vectorize(math.lgamma, otypes=[float])


def digamma(x: float) -> float:
    """Recurrence up to 10, then the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * 691 / 32760)))))


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return 1 - scale * h


def gamma_quantile(p: float, a: float, scale: float = 1.0) -> float:
    """Inverse of gammainc(a, x / scale) by bisection."""
    if p <= 0:
        return 0.0
    if p >= 1:
        return math.inf
    low, high = 0.0, max(1.0, a)
    while gammainc(a, high) < p:
        high *= 2
    while high - low > 1e-15 * max(high, 1e-300):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if gammainc(a, mid) < p else (low, mid)
    return scale * (low + high) / 2


def beta_binomial(n: int, a: float, b: float) -> np.ndarray:
    """Probabilities of 0 to n."""
    k = np.arange(n + 1)
    log = lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + lgamma(k + a) + lgamma(n - k + b) - lgamma(n + a + b) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)
    return np.exp(log)


def beta_binomial_slopes(n: int, a: float, b: float) -> dict[str, np.ndarray]:
    """Derivatives of beta_binomial() by a and b."""
    chance, common = beta_binomial(n, a, b), digamma(a + b) - digamma(n + a + b)
    by_a, by_b = (np.array([digamma(k + x) - digamma(x) + common for k in range(n + 1)]) for x in (a, b))
    return {"a": chance * by_a, "b": chance * by_b[::-1]}


def geometric_threshold(mean: float, alpha: float = 0.01) -> float:
    """The count that a geometric variable of this mean exceeds with probability alpha."""
    return math.log(alpha) / math.log(1 - 1 / (mean + 1)) - 1
