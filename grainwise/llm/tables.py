"""How many tables the customers of a dish sit at, drawn from the exact conditional distribution.

Given the rate r of new tables, n customers of a dish sit at t tables with a chance in proportion to r**t / t! times the
probability that t table sizes add up to n; a size is k with the probability d (1-d) .. (k-1-d) / k!, d being the
discount. Up to SMALL customers, the chances come from the generalised Stirling numbers, computed once per process. Beyond,
the probability is an integral around the origin, taken on a parabola through the saddle point to about ten digits, and t is drawn by
rejection from a hat that holds because the chances are log-concave. Neither way leaves a customer or a t out.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

SMALL = 512
# Entries of the chances of small dishes held at once, and dishes whose integrals are taken at once.
AT_ONCE, WIDE_AT_ONCE = 65_536, 4096
# Points of the integral, and their distance at most.
POINTS, STEP = 27, 0.18
# Of the three points that hold a hat: standard deviations between them, times that they are moved at most (the hat holds wherever they
# stand), the least fall from the middle one in logarithms, and the most that the hat rises above it. Draws that are tried at once.
APART, FITS, LEAST, MOST, FEW = 1.1, 40, 0.2, 1.5, 64


@cache
def stirling(discount: float, size: int = SMALL) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers, by customers and tables; -inf where there is no such seating."""
    rows = np.full((size + 1, size + 1), -np.inf)
    rows[0, 0] = 0.0
    t = np.arange(1, size + 1)
    for n in range(size):
        stay = n - discount * t
        with np.errstate(divide="ignore", invalid="ignore"):
            rows[n + 1, 1:] = np.logaddexp(rows[n, :-1], np.where(stay > 0, rows[n, 1:] + np.log(np.abs(stay)), -np.inf))
    return rows


def log_sizes(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """log of the probability that so many table sizes add up to the customers."""
    out = np.empty(len(customers))
    for at in range(0, len(customers), WIDE_AT_ONCE):
        part = slice(at, at + WIDE_AT_ONCE)
        out[part] = _integral(customers[part].astype(np.float64), tables[part].astype(np.float64), discount)
    return out


def _integral(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    low, high = np.full(len(n), -70.0), np.full(len(n), 34.0)
    for _ in range(18):
        mid = (low + high) / 2
        y, rest = 1 / (1 + np.exp(-mid)), 1 / (1 + np.exp(mid))
        less = -np.expm1(d * np.log(y)) * y ** (1 - d) * n < t * d * rest
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    z = np.maximum(-np.log(rest), 2 / n)
    y, rest = -np.expm1(-z), np.exp(-z)
    g, g1, g2 = -np.expm1(d * np.log(y)), -d * y ** (d - 1) * rest, d * rest * ((1 - d) * y ** (d - 2) * rest + y ** (d - 1))
    spread = np.sqrt(np.maximum(t * (g2 / g - (g1 / g) ** 2), 1e-12))
    k = np.arange(POINTS + 1)
    h = np.minimum(STEP, 0.175 / (spread * z))[:, None]
    narrow = (spread < 3)[:, None]
    # Where the sizes hardly vary, the points stand evenly on a circle around the origin.
    bent = np.where(narrow, z[:, None] + 1j * np.pi * k / POINTS, z[:, None] * (1 + 1j * k * h) ** 2)
    slope = np.where(narrow, 1 / (2 * POINTS), z[:, None] / np.pi * h * (1 + 1j * k * h))
    weight = np.full(POINTS + 1, 2.0)
    weight[0] = 1.0
    weight = np.where(narrow & (k == POINTS), 1.0, weight)
    top = n * z + t * np.log(g)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.exp(n[:, None] * bent + t[:, None] * np.log(1 - np.exp(d * np.log(1 - np.exp(-bent)))) - top[:, None])
    total = (values * slope * weight).real.sum(axis=1)
    one, all_alone = t == 1, t == n
    total = np.where(all_alone, 1.0, np.maximum(total, 1e-300))
    out = np.log(total) + np.where(all_alone, n * math.log(d), top)
    if one.any():
        out[one] = [math.log(d) + math.lgamma(x - d) - math.lgamma(1 - d) - math.lgamma(x + 1) for x in n[one].tolist()]
    return out


def _log_factorials(t: np.ndarray) -> np.ndarray:
    return np.fromiter((math.lgamma(x + 1) for x in t.tolist()), np.float64, len(t))


def drawn(customers: np.ndarray, log_rate: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with so many customers each; ``log_rate`` is that of the rate of new tables."""
    tables = np.ones(len(customers), np.int64)
    some = np.flatnonzero((customers > 1) & (customers <= SMALL))
    ends = np.cumsum(customers[some])
    cuts = np.searchsorted(ends, np.arange(0, (ends[-1] if len(some) else 0) + AT_ONCE, AT_ONCE), side="right")
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            tables[some[a:b]] = _small(customers[some[a:b]], log_rate[some[a:b]], discount, rng)
    wide = np.flatnonzero(customers > SMALL)
    for at in range(0, len(wide), WIDE_AT_ONCE):
        part = wide[at: at + WIDE_AT_ONCE]
        tables[part] = _wide(customers[part], log_rate[part], discount, rng)
    return tables


def _small(n: np.ndarray, log_rate: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    t = np.arange(1, int(n.sum()) + 1) - np.repeat(starts, n)
    weight = stirling(d).ravel()[np.repeat(n * (SMALL + 1), n) + t] + t * np.repeat(log_rate + math.log(d), n)
    weight = np.exp(weight - np.repeat(np.maximum.reduceat(weight, starts), n))
    upto = np.cumsum(weight)
    before = np.concatenate([[0.0], upto])[starts]
    wanted = before + rng.random(len(n)) * (upto[starts + n - 1] - before)
    return np.clip(np.searchsorted(upto, wanted, side="right") - starts + 1, 1, n)


def _wide(n: np.ndarray, log_rate: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    def chance(of: np.ndarray, t: np.ndarray) -> np.ndarray:
        return t * log_rate[of] - _log_factorials(t) + log_sizes(n[of], t, d)

    every = np.arange(len(n))
    low, high = np.full(len(n), -70.0), np.full(len(n), 34.0)
    for _ in range(26):
        mid = (low + high) / 2
        log_y, log_rest = -np.logaddexp(0, -mid), -np.logaddexp(0, mid)
        less = np.log(n / d) + (1 - d) * log_y - log_rest < log_rate
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    middle = np.clip(np.exp(np.minimum(log_rate, 60.0)) * -np.expm1(d * log_y), 2, n - 1).astype(np.int64)
    wide, off = np.ceil(APART * np.sqrt(middle)).astype(np.int64), every
    points, heights = np.empty((3, len(n)), np.int64), np.empty((3, len(n)))
    for _ in range(FITS):
        left, right = np.maximum(1, middle - wide), np.minimum(n[off], middle + wide)
        points[:, off] = left, middle, right
        heights[:, off] = chance(np.tile(off, 3), points[:, off].ravel()).reshape(3, -1)
        at_left, at_middle, at_right = heights[:, off]
        to_left, to_right = middle - left, right - middle
        rise, fall = (at_middle - at_left) / to_left, (at_middle - at_right) / to_right
        # The chances fall on either side, and the hat is nowhere far above the middle.
        fine = ((at_middle - at_left >= LEAST) | (left == 1)) & ((at_middle - at_right >= LEAST) | (right == n[off]))
        fine &= np.maximum(rise * (to_right - 1), fall * (to_left - 1)) <= MOST
        # On to the top of the parabola through the three, as far apart as it is wide.
        bend = np.maximum((rise + fall) * 2 / (right - left), 1e-30)
        step = np.clip((rise * to_right - fall * to_left) / (right - left) / bend, -4 * wide, 4 * wide)
        next_middle = np.clip(middle + np.rint(step).astype(np.int64), 2, n[off] - 1)
        next_wide = np.minimum(np.ceil(APART / np.sqrt(bend)), 4 * wide).astype(np.int64)
        more = ~fine & ((next_middle != middle) | (next_wide != wide))
        off, middle, wide = off[more], next_middle[more], next_wide[more]
        if not len(off):
            break
    left, middle, right = points
    rise, fall = (heights[1] - heights[0]) / (middle - left), (heights[1] - heights[2]) / (right - middle)
    # The hat: the three points themselves; between and beyond them the chords, extended. By part, its height is start + slope * k at
    # origin + way * k, for k from 1 to size.
    start, none = heights[[0, 0, 1, 1, 1, 2, 2]], np.zeros(len(n))
    slope = np.stack([-rise, none, fall, none, rise, none, -fall])
    origin, way = points[[0, 0, 1, 1, 1, 2, 2]], np.array([-1, 0, -1, 0, 1, 0, 1])
    one = np.ones(len(n), np.int64)
    size = np.stack([left - 1, one, middle - left - 1, one, right - middle - 1, one, n - right])
    steep = np.maximum(np.abs(slope), 1e-300)
    with np.errstate(divide="ignore"):
        mass = start + np.where(slope > 0, slope * size, slope) + np.log(np.expm1(-steep * size) / np.expm1(-steep))
    upto = np.cumsum(np.exp(mass - mass.max(axis=0)), axis=0)
    tables, open_ = np.ones(len(n), np.int64), every
    while len(open_):
        # Several tries of few dishes cost as much as one.
        of = np.repeat(open_, max(1, FEW // len(open_)))
        part = (upto[:, of] <= rng.random(len(of)) * upto[-1, of]).sum(axis=0)
        m, a, s = size[part, of], steep[part, of], slope[part, of]
        k = np.clip(np.ceil(-np.log1p(rng.random(len(of)) * np.expm1(-a * m)) / a), 1, m).astype(np.int64)
        k = np.where(s > 0, m + 1 - k, k)
        t, level = origin[part, of] + way[part] * k, np.log1p(-rng.random(len(of)))
        # Between two of the points, the chances are not below their chord.
        taken = (way[part] == 0) | (((part == 2) | (part == 4)) & (level <= -(rise + fall)[of] * k))
        asked = np.flatnonzero(~taken)
        taken[asked] = level[asked] <= chance(of[asked], t[asked]) - (start[part, of] + s * k)[asked]
        done, first = np.unique(of[taken], return_index=True)
        tables[done] = t[taken][first]
        open_ = open_[~np.isin(open_, done)]
    return tables


def rest(rate: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Weights of what a restaurant has not seated yet: of laws with the transform exp(-rate * ((1 + s)**discount - 1)).

    A stable weight w is taken with the chance exp(-w); rates above 1 are sums of such draws.
    """
    parts = np.maximum(1, np.ceil(rate)).astype(np.int64)
    owner = np.repeat(np.arange(len(rate)), parts)
    scale, weights = (rate / parts)[owner] ** (1 / discount), np.zeros(len(owner))
    left = np.flatnonzero(scale > 0)
    while len(left):
        angle, e = rng.random(len(left)) * np.pi, rng.exponential(size=len(left))
        stable = np.sin(discount * angle) / np.sin(angle) ** (1 / discount) * (np.sin((1 - discount) * angle) / e) ** ((1 - discount) / discount)
        w = scale[left] * stable
        kept = rng.random(len(left)) < np.exp(-w)
        weights[left[kept]] = w[kept]
        left = left[~kept]
    return np.bincount(owner, weights=weights, minlength=len(rate))
