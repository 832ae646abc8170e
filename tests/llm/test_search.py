import random

import numpy as np
import pytest

from millrace.llm import topk_search


def brute(rows, k):
    codes = sorted({(i, tuple(x is not None and x > 0 for x in v)) for i, v in rows if i is not None and v})
    out = {}
    for i in {i for i, _ in codes}:
        best = {}
        for a, x in codes:
            for b, y in codes:
                if a == i and b != i and len(x) == len(y):
                    d = sum(p != q for p, q in zip(x, y))
                    best[b] = min(d, best.get(b, 1 << 30))
        for r, (d, b) in enumerate(sorted((d, b) for b, d in best.items())[:k], 1):
            out[i, r] = (b, d)
    return out


def run(spark, rows, k, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as id", "'x' as code", "'x' as key")
    return {(r.query_id, r.rank): (r.neighbour_id, r.distance) for r in topk_search.top_k(df, k=k, **more).collect()}


@pytest.mark.parametrize("dims,n,low", [(64, 120, 12), (20, 200, 2), (100, 40, 3)])
def test_search_equals_brute_force(spark, dims, n, low):
    rng = np.random.default_rng(dims)
    vectors = rng.standard_normal((n, dims))
    vectors[n // 2 : n // 2 + 15] = vectors[0]  # ties beyond k
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    assert run(spark, rows, 5, low=low) == brute(rows, 5)


def test_search_bears_hard_rows(spark):
    rng = random.Random(2)
    v = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    same = v(16)
    rows = [(1, same), (1, same), (2, same), (3, None), (4, []), (None, v(16)), (5, [None] * 16), (6, [float("nan")] * 16), (7, v(8)), (8, v(8)), (9, v(3)), (2, v(16))]
    assert run(spark, rows, 3) == brute([(i, [x if x is not None and x == x else 0.0 for x in w] if w else w) for i, w in rows], 3)
    assert run(spark, [], 3) == {} and run(spark, [(1, same)], 3) == {}


def test_many_ties_within_a_tile_go_to_the_smaller_id(spark):
    """More codes at the kth distance than a tile returns: codes two bits from one centre, whose smallest ids decide."""
    rng = np.random.default_rng(4)
    centre, rows = rng.random(32) > 0.5, []
    for a in range(32):
        for b in range(a + 1, 32):
            code = centre.copy()
            code[[a, b]] ^= True
            rows.append([1.0 if x else -1.0 for x in code])
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[j]) for i, j in enumerate(order)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_ids_with_several_vectors_take_one_place_each(spark):
    """Every id has near copies of its vector, more than k + 1 codes in all, and still k neighbours."""
    rng = np.random.default_rng(6)
    rows = []
    for i, v in enumerate(rng.standard_normal((40, 48))):
        for _ in range(9):
            near = v.copy()
            near[rng.integers(48, size=2)] *= -1
            rows.append((i, [float(x) for x in near]))
    found = run(spark, rows, 4)
    assert found == brute(rows, 4) and len(found) == 4 * 40


def test_queries_are_a_part_of_the_ids_and_neighbours_are_of_all(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.repeat(rng.standard_normal((50, 24)), [30] + [2] * 49, axis=0))]
    want = {(q, r): v for (q, r), v in brute(rows, 5).items() if q % 20 == 0}
    assert run(spark, rows, 5, every=20) == want and want
    assert run(spark, [(1, [1.0] * 8), (2, [1.0] * 8)], 5, every=20) == {}
