import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktide.llm import inner_product
from clicktide.plans.scratch import shared_folder


def brute(rows, k=5, step=50):
    usable = {}
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable[vec_id] = [math.floor(256 * x) for x in vector]
    out = []
    for q, a in usable.items():
        if q % step == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in usable.items() if v != q)
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, **sizes):
    shared_folder(spark)
    df = spark.createDataFrame([(i, v, 3, 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, length double")
    got = inner_product.top_products(df, F.col("vec_id") % 50 == 0, **sizes)
    return sorted(tuple(r) for r in got.collect())


def f32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 16, "query_rows": 2}])
def test_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(400):
        # long and short vectors, tight directions: all kinds of pruning apply
        v = centres[i % 6] + rng.normal(scale=0.02, size=12)
        rows.append((i, (v * rng.lognormal(sigma=1.0)).tolist()))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1050, [0.0] * 12), (1100, [-9.0] * 12)]
    rows += [(1101, None), (1150, [None] * 12), (1151, [float("nan")] * 12), (1200, [float("inf")] + [0.0] * 11), (None, [1.0] * 12)]
    rows = f32(rows)
    assert search(spark, rows, **sizes) == brute(rows)


def test_all_prunings_are_exact():
    rng = np.random.default_rng(2)
    seen = Counter()
    for case in range(60):
        base = rng.normal(size=(1, 10))
        vectors = np.floor(256 * (base + rng.normal(scale=0.05, size=(200, 10))) * rng.uniform(0.2, 2, size=(200, 1))).astype("<i4")
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-lengths)
        vectors, lengths, ids = vectors[order], lengths[order], order
        queries = np.floor(256 * (base * rng.choice([-1, 1, 0.5]) + rng.normal(scale=rng.choice([0.02, 0.5]), size=(20, 10)))).astype("<i4")
        q_lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        products = queries.astype(np.int64) @ vectors.T.astype(np.int64)
        least = np.sort(products, axis=1)[:, -int(rng.integers(1, 6))].astype(float) + rng.choice([0, 0, 10**7])
        count = {}
        got = inner_product.search_bucket(queries, q_lengths, least, vectors, lengths, 5, np.full(20, -1), ids, count)
        seen.update(count)
        for q in range(20):
            want = sorted((-int(s), int(ids[v])) for v, s in enumerate(products[q]) if s >= least[q])[:5]
            assert sorted((-s, int(ids[v])) for r, v, s in got if r == q) == want
    assert min(seen["skipped"], seen["coordinate"], seen["length"]) > 20


def test_large_components_and_ragged_vectors(spark):
    rows = f32([(0, [8.0e5, 3.0]), (1, [7.9e5]), (3, [2.0, 2.0, 5.0]), (50, []), (51, [-1.0e6, 4.0])])
    pad = [(i, v + [0.0] * (3 - len(v))) for i, v in rows]
    assert search(spark, rows) == brute(pad)


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 3, "query_rows": 2}])
def test_long_vectors_take_part(spark, sizes):
    # lengths of 2**31 and more: scores beyond doubles, and beyond longs on the way
    rows = f32([(0, [9.0e6, 0.0]), (1, [9.0e6, 1.0]), (2, [3.0, -1.0]), (3, [9.0e6, 1.0001]), (50, [0.0, 1.0e30]), (51, [1.0e7, -3.0]), (100, [1.0e12, 1.0])])
    rows += [(200 + i, [1000.0 + i, 0.0]) for i in range(9)] + [(300, [-2.0e7, 0.0])]
    usable = [r for r in rows if r[0] not in (50, 100)]
    assert search(spark, usable, **sizes) == brute(usable)
    few = [(0, [1.0e30, 0.0]), (2, [0.0, 5.0]), (3, [0.0, -1.0])] + [(i, [0.0, 0.5]) for i in range(10, 14)]
    assert search(spark, f32(few), **sizes) == brute(f32(few))
    with pytest.raises(Exception, match="exceeds the range of a long"):
        search(spark, f32([(0, [1.0e30]), (1, [1.0e30])]), **sizes)


def test_exact_beyond_doubles():
    q = np.array([[2.0**40 + 2**20, 3.0]])
    v = np.array([[2.0**41, 5.0], [2.0**41, 6.0], [2.0**60, -1.0]])
    lengths = np.sqrt((v**2).sum(axis=1))
    order = np.argsort(-lengths)
    got = inner_product.search_bucket(q, np.sqrt((q**2).sum(axis=1)), np.array([-np.inf]), v[order], lengths[order], 5, np.array([9]), order)
    want = [sum(int(a) * int(b) for a, b in zip(q[0], row)) for row in v]
    # the query's product with the longest needs more than 63 bits
    assert {order[i]: s for _, i, s in got} == {i: min(w, inner_product.NO_LONG) for i, w in enumerate(want)}


def test_equal_vectors_in_bulk(spark):
    rows = f32([(i, [0.25, -0.5]) for i in range(300)])
    assert search(spark, rows, bucket_rows=8, query_rows=4) == brute(rows)


def test_few_or_no_rows(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert search(spark, [(0, [1.0]), (2, [2.0])]) == [(0, 1, 2, 256 * 512)]
    repeated = search(spark, [(0, [1.0]), (0, [1.0]), (2, [2.0]), (2, [2.0])])
    assert repeated == [(0, 1, 2, 256 * 512)]
