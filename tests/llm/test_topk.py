import math

import numpy as np
from conftest_llm import FOLDER

from grainwise.llm import topk
from grainwise.llm.queries import QUERIES, SQL


def brute(values, k=20, every=20):
    good = {i: [math.floor(64 * x) for x in v] for i, v in values if v and None not in v and np.isfinite(v).all()}
    out = []
    for q, x in good.items():
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good.items() if i != q and len(y) == len(x))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best[:k], 1)]
    return sorted(out)


def check(llm, values, **options):
    rows = llm.createDataFrame([(i, v, 0, 0.0) for i, v in values], "vec_id bigint, embedding array<double>, length int, score double")
    got = topk.top_k(rows, **options)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute(values)


def test_lengths_ties_and_blocks(llm):
    rng = np.random.default_rng(8)
    values = [(i, (rng.standard_normal(16) * rng.choice([0.01, 0.3, 1, 4])).tolist()) for i in range(400)]
    values += [(400 + i, values[3][1]) for i in range(60)] + [(500, None), (520, []), (540, [0.0] * 16), (560, [float("inf")] * 16), (580, [1.0, 2.0]), (581, [3.0, -1.0]), (600, [None] * 16)]
    check(llm, values)
    check(llm, values, candidates=50, queries=7)


def test_steep_thresholds_prune_and_lose_nothing(llm):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 24))
    values = [(i, (centres[i % 6] + 0.05 * rng.standard_normal(24)).tolist()) for i in range(300)]
    check(llm, values, candidates=64)


def test_large_components_stay_exact(llm):
    values = [(i, [float(2**24 + i), float(i * 2**20), -1.0]) for i in range(40)]
    check(llm, values)


def test_few_rows_and_empty_tables(llm):
    check(llm, [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (7, [1.0, 1.0])])
    check(llm, [(1, [1.0, 2.0])])
    assert topk.top_k(llm.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_query_against_sql(llm, duck):
    want = duck.execute(SQL["op6_top_k"]).fetchall()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in QUERIES["op6_top_k"](llm, FOLDER).collect()) == sorted(want)
