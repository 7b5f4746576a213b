import numpy as np
import pytest

from grainwise.llm import tables


def exact(n, log_rate, discount):
    t = np.arange(1, n + 1)
    weight = tables.stirling(discount, n)[n, 1:] + t * (log_rate + np.log(discount))
    weight = np.exp(weight - weight.max())
    return weight / weight.sum()


def asked_of(monkeypatch):
    asked, plain = [], tables.log_sizes
    monkeypatch.setattr(tables, "log_sizes", lambda n, t, d: asked.append(len(n)) or plain(n, t, d))
    return asked


# Where a side of the hat was nearly level before, and where the most likely number of tables is at an edge.
@pytest.mark.parametrize("n,log_rate", [(859, 2.0037), (1460, 2.3874), (1098, 0.6798), (687, 2.3822), (600, -3.0), (600, 14.0), (900, 6.0)])
def test_large_dishes_need_few_chances(n, log_rate, monkeypatch):
    asked = asked_of(monkeypatch)
    tables.drawn(np.full(400, n), np.full(400, log_rate), 0.7, np.random.default_rng(n))
    assert sum(asked) < 16 * 400 and len(asked) < 40


def test_a_hat_at_the_edge_stands_close(monkeypatch):
    """Nearly all customers sit alone, so the most likely number of tables is just below that of the customers."""
    asked = asked_of(monkeypatch)
    got = tables.drawn(np.full(400, 580_055), np.full(400, 23.895637781185968), 0.6, np.random.default_rng(1))
    assert sum(asked) < 24 * 400 and len(asked) < 40 and got.min() > 580_000


@pytest.mark.parametrize("n,log_rate", [(859, 2.0037), (1098, 0.6798), (600, -0.7), (600, 4.0), (513, 7.0), (900, 9.0), (900, 14.0)])
def test_every_number_of_large_dishes_has_its_chance(n, log_rate):
    many = 30_000
    got = np.bincount(tables.drawn(np.full(many, n), np.full(many, log_rate), 0.7, np.random.default_rng(7)), minlength=n + 1)[1:]
    wanted = exact(n, log_rate, 0.7) * many
    some = wanted > 20
    excess = ((got - wanted)[some] ** 2 / wanted[some]).sum() - some.sum()
    assert abs(excess) < 5 * np.sqrt(2 * some.sum())
    assert got[~some].sum() == pytest.approx(wanted[~some].sum(), abs=5 * np.sqrt(wanted[~some].sum()) + 1)


def test_draws_hold_at_any_three_points(monkeypatch):
    """The hat may stand badly, which costs tries and no accuracy."""
    monkeypatch.setattr(tables, "FITS", 1)
    got = tables.drawn(np.full(20_000, 700), np.full(20_000, 2.0), 0.7, np.random.default_rng(3))
    p, t = exact(700, 2.0, 0.7), np.arange(1, 701)
    mean = (p * t).sum()
    spread = np.sqrt((p * (t - mean) ** 2).sum())
    assert abs(got.mean() - mean) < 5 * spread / np.sqrt(20_000) and abs(got.std() - spread) < 0.05 * spread
