import math
import random

import pytest
from pyspark.sql import functions as F

from tocsin.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every=5):
    fine = {(i, tuple(math.floor(256 * x) for x in v)) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in fine:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 3])
def test_like_brute_force(table, parts):
    rng = random.Random(parts)
    rows = [(i, [float(rng.choice([-1, -0.3, 0, 0.25, 0.9])) for _ in range(6)], 0) for i in range(300)]
    rows += [(i, [0.5] * 6, 0) for i in range(300, 400)]  # one very common vector: ties
    rows += [(400, None, 0), (401, [None] * 6, 0), (402, [float("nan")] * 6, 0), (403, [float("inf")] + [0.0] * 5, 0),
             (None, [0.1] * 6, 0), (7, rows[7][1], 9), (405, [-1e4] * 6, 0)]
    got = top_k(table(rows, SCHEMA), F.col("id") % 5 == 0, parts=parts, block_rows=64, block_queries=16)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_large_components_stay_exact(table):
    rows = [(i, [2.0**20 + i, -(2.0**20)], 0) for i in range(30)]
    got = top_k(table(rows, "vec_id long, embedding array<double>, label int"), F.col("id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_few_candidates_and_empty(table):
    rows = [(0, [1.0, 2.0], 0), (3, [0.5, -1.0], 0)]
    got = top_k(table(rows, SCHEMA), F.col("id") % 5 == 0)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 3, 256 * 128 - 512 * 256)]
    assert top_k(table(rows[:1], SCHEMA), F.col("id") % 5 == 0).collect() == []
    assert top_k(table([], SCHEMA), F.col("id") % 5 == 0).collect() == []
