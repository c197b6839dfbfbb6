"""The law of the number of tables in a Pitman-Yor restaurant.

``n`` customers of one dish, discount ``d``, weight ``a`` of a new table: t tables
have probability proportional to S(n, t) * a**t, where S is the generalised
Stirling number S(n+1, t) = S(n, t-1) + (n - d*t) * S(n, t). Draws are exact and
independent of what was drawn before: up to MOST customers from that recurrence's
table, beyond by rejection under two tangents (S is log-concave in t), where
log S comes from the contour integral of its generating function,
S(n, t) = n! / (t! d**t) [z**n] (1 - (1-z)**d)**t, along a parabola through the
saddle point. The cost of a draw is bounded whatever ``n`` is.
"""

from __future__ import annotations

from functools import cache
from math import lgamma

import numpy as np

MOST = 1024
_LGAMMA = np.array([0.0] + [lgamma(k) for k in range(1, 65)])


def log_factorial(t: np.ndarray) -> np.ndarray:
    """log t!, by Stirling's series from 63 on."""
    x = np.maximum(t, 63.0) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(t < 63, _LGAMMA[np.minimum(t, 63).astype(np.int64) + 1], series)


@cache
def log_stirling(discount: float, most: int = MOST) -> np.ndarray:
    """log S(n, t) for all n, t up to ``most`` by the recurrence."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(most + 1)
    for n in range(1, most):
        stay = out[n] + np.log(np.maximum(n - discount * t, 1e-300))
        out[n + 1, : n + 2] = np.logaddexp(stay, np.append(-np.inf, out[n, :-1]))[: n + 2]
    return out


def _bisect(wanted: np.ndarray, log_of) -> np.ndarray:
    """Where the decreasing function of a logit has the value ``wanted``."""
    low, high = np.full(wanted.shape, -700.0), np.full(wanted.shape, 60.0)
    for _ in range(80):
        middle = (low + high) / 2
        above = log_of(middle) > wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def log_stirling_by_contour(discount: float, n: np.ndarray, t: np.ndarray, nodes: int = 100) -> np.ndarray:
    """log(S(n, t) / n!) with an error of 1e-8, and of 1e-4 where t is within a hundredth of n; the cost depends on neither."""
    d, n, t = discount, np.asarray(n, float), np.asarray(t, float)
    if len(n) > 2000:
        return np.concatenate([log_stirling_by_contour(d, n[i : i + 2000], t[i : i + 2000], nodes) for i in range(0, len(n), 2000)])

    def slope(m):
        log_z = -np.logaddexp(0, -m)
        return np.log(d) + (d - 1) * log_z - np.logaddexp(0, m) - np.log(-np.expm1(d * log_z))

    m = _bisect(np.log((n + 1) / np.minimum(t, n)), slope)
    rest = 1 / (1 + np.exp(m))  # one less the saddle point
    rest = np.where(rest > 1 - 3 / (n + 1), np.maximum(1 - 3 / (n + 1), 0), rest)
    z = np.where(rest < 0.5, 1 - rest, np.maximum(1 / (1 + np.exp(-m)), 3 / (n + 1)))
    log_z = np.where(z < 0.5, np.log(z), np.log1p(-rest))
    power = np.exp(d * log_z)
    peak = t * np.log(-np.expm1(d * log_z)) - (n + 1) * np.log(rest)
    curve = np.abs(t * (d * (1 - d) * power / z**2 / (1 - power) - (d * power / z / (1 - power)) ** 2) + (n + 1) / rest**2)
    scale = 1.5 * np.minimum(1 / (2 * z * np.sqrt(curve)), 1.0)[:, None]
    step = 4.5 / nodes
    x = (np.arange(nodes) + 0.5) * step
    s = 1j * scale * np.sinh(x)
    point = log_z[:, None] + 2 * np.log1p(s)
    height = t[:, None] * np.log(-np.expm1(d * point)) - (n[:, None] + 1) * np.log(rest[:, None] - z[:, None] * (2 * s + s * s)) - peak[:, None]
    along = 2j * z[:, None] * (1 + s) * scale * np.cosh(x) * step
    area = (np.exp(height) * along).imag.sum(axis=1) / np.pi
    out = peak + np.log(np.maximum(area, 1e-300)) - log_factorial(t) - t * np.log(d)
    return np.where(t >= n, -log_factorial(n), out)


def _draw_few(n: np.ndarray, log_a: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """By the inverse distribution function, all dishes of one count at a time."""
    out = np.ones(len(n), np.int64)
    table = log_stirling(discount)
    order = np.argsort(n, kind="stable")
    counts, first = np.unique(n[order], return_index=True)
    for c, a, b in zip(counts.tolist(), first.tolist(), [*first[1:].tolist(), len(n)]):
        if c < 2:
            continue
        t = np.arange(1, c + 1)
        for at in range(a, b, max(1, 500_000 // c)):
            rows = order[at : min(b, at + max(1, 500_000 // c))]
            log_p = table[c, 1 : c + 1] + t * log_a[rows, None]
            mass = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
            out[rows] = 1 + (mass < u[rows, None] * mass[:, -1:]).sum(axis=1)
    return np.minimum(out, np.maximum(n, 1))


def _geometric(u: np.ndarray, slope: np.ndarray, size: np.ndarray) -> np.ndarray:
    """k in 0..size-1 with weight exp(-slope * k), slope positive."""
    return np.minimum(np.floor(-np.log1p(u * np.expm1(-slope * size)) / slope), size - 1)


def _draw_many(n: np.ndarray, log_a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """By rejection under two tangents of the logarithm."""
    d, n = discount, n.astype(float)
    rate = np.exp(log_a) / d

    def log_p(who, t):
        return log_stirling_by_contour(d, n[who], t) + t * log_a[who]

    def mode_slope(m):
        return (d - 1) * -np.logaddexp(0, -m) - np.logaddexp(0, m)

    m = _bisect(np.log(n + 1) - np.log(rate) - np.log(d), mode_slope)
    mode = np.clip(np.rint(rate * -np.expm1(-d * np.logaddexp(0, -m))), 1, n)
    spread = np.maximum(1, np.rint(0.8 * np.sqrt(np.minimum(mode, np.maximum(n - mode, 1)))))
    left, right = np.clip(mode - spread, 1, n - 1), np.clip(mode + spread + 1, 2, n)
    everyone = np.arange(len(n))
    at_left, at_right = log_p(everyone, left), log_p(everyone, right)
    up = log_p(everyone, left + 1) - at_left  # log p(t) <= at_left + (t - left) * up
    down = at_right - log_p(everyone, right - 1)  # and <= at_right + (t - right) * down
    # concave, so up >= down; where both have one sign the mode is at an end, and one tangent will do
    tiny = 1e-9
    cut = np.floor((at_right - at_left + left * up - right * down) / np.maximum(up - down, tiny))
    cut = np.where(up <= tiny, 0, np.where(down >= -tiny, n, np.clip(cut, 0, n)))
    rise, fall = np.maximum(up, tiny), np.maximum(-down, tiny)

    def log_area(top, slope, size):
        return np.where(size > 0, top + np.log(-np.expm1(-slope * np.maximum(size, 1))) - np.log(-np.expm1(-slope)), -np.inf)

    top_left, top_right = at_left + (cut - left) * rise, at_right - (cut + 1 - right) * fall
    area_left, area_right = log_area(top_left, rise, cut), log_area(top_right, fall, n - cut)
    to_left = 1 / (1 + np.exp(np.clip(area_right - area_left, -700, 700)))
    out, todo = np.ones(len(n)), everyone
    while len(todo):
        u, v, w = rng.random((3, len(todo)))
        lower = u < to_left[todo]
        k = _geometric(v, np.where(lower, rise[todo], fall[todo]), np.where(lower, cut[todo], n[todo] - cut[todo]))
        t = np.where(lower, cut[todo] - k, cut[todo] + 1 + k)
        hat = np.where(lower, top_left[todo] - k * rise[todo], top_right[todo] - k * fall[todo])
        good = np.log(w) <= log_p(todo, t) - hat
        out[todo[good]] = t[good]
        todo = todo[~good]
    return out.astype(np.int64)


def draw(n: np.ndarray, log_a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with ``n`` customers; none without customers."""
    out = np.minimum(n, 1).astype(np.int64)
    few, many = np.flatnonzero((n > 1) & (n <= MOST)), np.flatnonzero(n > MOST)
    out[few] = _draw_few(n[few], log_a[few], discount, rng.random(len(few)))
    if len(many):
        out[many] = _draw_many(n[many], log_a[many], discount, rng)
    return out
