import math
import random

import numpy as np
import pytest
from conftest_llm import FOLDER

from grainwise.llm import whitening
from grainwise.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("kind", ["plain", "equal rows", "flat dimension", "powers", "few directions", "close values"])
def test_spectra_follow_the_scatter_matrix(kind):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(120, 9)) * 300)
    if kind == "equal rows":
        x[20:90] = x[0]
    elif kind == "flat dimension":
        x[:, 4] = 7
    elif kind == "powers":
        x = np.floor(x * 10.0 ** np.arange(-2, 7))
    elif kind == "few directions":
        x = np.outer(x[:, 0], np.arange(9)) + np.outer(x[:, 1], np.ones(9))
    elif kind == "close values":
        x = np.concatenate([np.eye(9) * 1000, -np.eye(9) * 1000] * 6) + (x[:108] % 2)
    parts = [whitening.Spectrum.none(9) for _ in range(3)]
    for i, row in enumerate(x):
        parts[i * 3 // len(x)].add(row)
    whole = whitening.Spectrum.read(parts[0].write(), 9)
    for p in parts[1:]:
        whole.join(p)
    for s, rows in [(parts[0], x[: len(x) // 3]), (whole, x)]:
        centred = rows - rows.mean(axis=0)
        scatter = centred.T @ centred
        assert np.abs(s.q.T @ s.q - np.eye(9)).max() < 1e-12
        assert np.abs(s.q @ np.diag(s.d) @ s.q.T - scatter).max() <= 1e-11 * np.abs(scatter).max()
        assert np.abs(s.d - np.linalg.eigvalsh(scatter)).max() <= 1e-12 * np.abs(scatter).max()


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(5)
    for m in (1, 2, 3, 30):
        d, z2 = np.cumsum(rng.exponential(size=m) * 10.0 ** rng.integers(-6, 3, m)), rng.exponential(size=m) * 10.0 ** rng.integers(-8, 3, m)
        near, x = whitening.secular_roots(d, z2)
        roots = np.sort(np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2))))
        assert np.abs(d[near] + x - roots).max() <= 1e-12 * roots.max()


def expected(rows):
    """Integers, exact sums and a whole eigendecomposition on one machine."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(kept), x.sum(axis=0)
    centred = (x * n - sums).astype(np.float64) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return kept, n, [int(sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for row in x], centred, values, vectors


def check(got, rows, ids=True):
    kept, n, deviation, centred, values, vectors = expected(rows)
    k = min(8, len(values))
    assert len(got) == n * k
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = np.zeros(k)
    for (i, _), dev, c in zip(kept, deviation, centred, strict=True):
        for j in range(k):
            r, want = by_row[i][j + 1], c @ vectors[:, j] / math.sqrt(values[j])
            signs[j] = signs[j] or (np.sign(want * r["whitened"]) if abs(want) > 1e-3 else 0)
            assert r["n"] == n and r["deviation"] == dev
            assert r["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-9)
            assert abs(r["whitened"] * (signs[j] or 1) - want) < 1e-6
            assert r["identity_error"] < 1e-9


def vectors(n, width, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1 / (j + 1)) for j in range(width)]) for i in range(n)]


def test_random_rows_over_many_tasks(llm):
    rows = vectors(700, 12)
    check(whitening.whiten(llm.createDataFrame(rows, SCHEMA).repartition(40)).collect(), rows)


def test_edges(llm):
    bad = [(900, None), (901, [None, *[0.0] * 4]), (902, [math.nan] * 5), (903, [math.inf, *[0.0] * 4]), (904, [])]
    rows = vectors(60, 5) + bad
    extra = llm.createDataFrame([(i, v, 1.0, 2, None) for i, v in rows], SCHEMA + ", component float, n int, whitened string")
    check(whitening.whiten(extra).collect(), rows[:-1])
    other = llm.createDataFrame([*rows, (905, [1.0, 2.0])], SCHEMA)
    assert whitening.whiten(other).count() == 300


def test_equal_rows_nulls_and_empty_tables(llm):
    same = whitening.whiten(llm.createDataFrame([(None, [0.5, 0.25]), (3, [0.5, 0.25]), (3, [0.5, 0.25])], SCHEMA)).collect()
    assert len(same) == 6
    assert all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (3, 0, None, None, 0.0) for r in same)
    line = whitening.whiten(llm.createDataFrame([(i, [i / 8, i / 4]) for i in range(5)], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and {r["explained"] for r in line if r["component"] == 2} == {0.0}
    empty = whitening.whiten(llm.createDataFrame([(1, None)], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_are_exact_or_null():
    model = whitening.Whitening(3, np.array([2**33, 5]), np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[2**31, 1], [2**32, 2]])
    assert model.deviations(x) == [(3 * 2**31 - 2**33) ** 2 + 4, None]


def test_query(llm):
    rows = [(r["vec_id"], r["embedding"]) for r in llm.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(QUERIES["op13_whitening"](llm, FOLDER).collect(), rows)
