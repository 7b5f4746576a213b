import math
import random

import numpy as np
import pytest

from grainwise.llm import hpy, tables


def chances(n, log_rate, d):
    """By the recursion over customers, in plain floats: the chance of every number of tables."""
    weight = {1: math.log(d) + log_rate}
    for sat in range(1, n):
        new = {}
        for t, w in weight.items():
            for to, more in ((t, math.log(sat - d * t)), (t + 1, math.log(d) + log_rate)):
                new[to] = w + more if to not in new else max(new[to], w + more) + math.log1p(math.exp(-abs(new[to] - w - more)))
        weight = new
    top = max(weight.values())
    parts = np.array([math.exp(weight[t] - top) for t in range(1, n + 1)])
    return parts / parts.sum()


@pytest.mark.parametrize("n", [1, 2, 7, 60, 512, 513, 700])
@pytest.mark.parametrize("log_rate", [-40.0, -1.0, 2.0, 5.0, 8.0])
def test_tables_follow_their_exact_conditional(n, log_rate):
    p, t = chances(n, log_rate, 0.7), np.arange(1, n + 1)
    got = tables.drawn(np.full(4000, n), np.full(4000, log_rate), 0.7, np.random.default_rng(n))
    mean = (p * t).sum()
    spread = math.sqrt((p * (t - mean) ** 2).sum())
    assert abs(got.mean() - mean) < 5 * spread / math.sqrt(4000) + 0.002 and abs(got.std() - spread) < 0.08 * spread + 0.03
    assert got.min() >= 1 and got.max() <= n


def test_sizes_of_many_customers():
    """The integral against Stirling numbers of twice the customers that they are kept for."""
    n, d = 2 * tables.SMALL, 0.6
    t = np.arange(1, n + 1)
    whole = tables.stirling(d, n)[n, 1:] + t * math.log(d) + [math.lgamma(x + 1) - math.lgamma(n + 1) for x in t]
    assert np.abs(tables.log_sizes(np.full(n, n), t, d) - whole).max() < 1e-8


def test_a_hot_dish_takes_no_longer_and_none_is_left_out():
    got = tables.drawn(np.array([10**8, 1, 10**6, 3]), np.array([9.0, 1.0, -30.0, 0.0]), 0.7, np.random.default_rng(1))
    assert got[0] > 1000 and got[1] == 1 and got[2] == 1 and 1 <= got[3] <= 3
    assert len(tables.drawn(np.zeros(0, np.int64), np.zeros(0), 0.7, np.random.default_rng(1))) == 0


def one_by_one(counts, base, sweeps, rng):
    """The sampler as it is told: every customer leaves its table and sits down again, at both levels. Mean tables by type, and of the root."""
    cd, cs, rd, rs = hpy.CONTEXT_D, hpy.CONTEXT_S, hpy.ROOT_D, hpy.ROOT_S
    rest, root = {}, {w: [] for w in base}
    def root_chance(w):
        n, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(root[w]) - rd * len(root[w]) + (rs + rd * t) * base[w]) / (rs + n)
    def pick(sizes, d, new):
        weights = [x - d for x in sizes] + [new]
        i = rng.choices(range(len(weights)), weights)[0]
        if i == len(sizes):
            sizes.append(0)
        sizes[i] += 1
        return i == len(sizes) - 1 and sizes[i] == 1
    def leave(sizes):
        i = rng.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        return not sizes[i] and not sizes.pop(i)
    def sit(c, w):
        open_ = sum(len(s) for (x, _), s in rest.items() if x == c)
        if pick(rest.setdefault((c, w), []), cd, (cs + cd * open_) * root_chance(w)):
            t = sum(map(len, root.values()))
            pick(root[w], rd, (rs + rd * t) * base[w])
    for (c, w), n in counts.items():
        for _ in range(n):
            sit(c, w)
    sums, root_sum = dict.fromkeys(counts, 0), 0
    for _ in range(sweeps):
        for (c, w), n in counts.items():
            for _ in range(n):
                if leave(rest[c, w]):
                    leave(root[w])
                sit(c, w)
        for k in counts:
            sums[k] += len(rest[k])
        root_sum += sum(map(len, root.values()))
    return {k: v / sweeps for k, v in sums.items()}, root_sum / sweeps


def test_sweeps_agree_with_seating_customers_one_by_one(monkeypatch):
    counts = {(0, b"a"): 12, (97, b"a"): 4, (0, b"bb"): 30, (97, b"bb"): 2, (97, b"c"): 8}
    base = {b"a": 0.03, b"bb": 0.004, b"c": 0.0005}
    monkeypatch.setattr(hpy, "spelled", lambda words, table: np.log10([base[w] for w in words]))
    by_word = [[k for k in sorted(counts) if k[1] == w] for w in base]
    row = {"word": b" ".join(base), "sizes": np.array([len(x) for x in by_word], "<u2").tobytes(),
           "contexts": np.array([c for x in by_word for c, _ in x], "u1").tobytes(), "counts": np.array([counts[k] for x in by_word for k in x], "<u8").tobytes()}
    seen, roots = [], []
    for bucket in range(150):
        totals = []
        for sweep in range(15):
            s = hpy._seats(row | {"bucket": bucket}, None, totals, 2, sweep)
            totals.append(hpy._state(hpy._sums(s), sweep))
            if sweep > 3:
                seen.append(s.tables)
                roots.append(s.root_tables.sum())
    wanted, root = one_by_one(counts, base, 6000, random.Random(3))
    for mine, k in zip(np.mean(seen, axis=0), [k for x in by_word for k in x], strict=True):
        assert mine == pytest.approx(wanted[k], rel=0.06), k
    assert np.mean(roots) == pytest.approx(root, rel=0.06)
