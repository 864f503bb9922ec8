import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktide.llm import centroids
from clicktide.plans.scratch import shared_folder

def order():
    return F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)



def brute(rows, k, dims, rounds, scale=64):
    kept = [
        (i, [math.floor(scale * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds if centres else 0):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted([(i, nearest(v)[1], nearest(v)[0]) for i, v in kept] if centres else [], key=repr), centres


def run(spark, rows, **options):
    shared_folder(spark)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, cells string")
    got, centres = centroids.cluster_vectors(df.repartition(3), order(), **options)
    return sorted(map(tuple, got.collect()), key=repr), centres, got


@pytest.mark.parametrize("seed,spread", [(1, 0.3), (2, 3.0), (3, 0.0)])
def test_equals_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, 6)) * 2
    rows = [(i, (middles[i % 7] + rng.normal(size=6) * spread).tolist()) for i in range(300)]
    rows += [(i + 1000, [0.5, -0.5, 0.25, 0.0, 0.0, 1.0]) for i in range(40)] + [rows[0], rows[0], (None, rows[1][1]), (None, None)]
    rows += [(2000, None), (2001, [1.0] * 5), (2002, [float("nan")] * 6), (2003, [None] * 6), (2004, [float("inf")] + [0.0] * 5), (2005, [])]
    got, centres, _ = run(spark, rows, k=9, dims=6, rounds=4)
    assert (got, centres) == brute(rows, 9, 6, 4)


def test_bounds_pass_over_distances_and_stay_exact():
    rng = np.random.default_rng(0)
    vectors = np.floor(64 * (np.repeat(rng.normal(size=(8, 10)) * 4, 100, axis=0) + rng.normal(size=(800, 10)))).astype(np.int64)
    history = [vectors[rng.choice(800, 8, replace=False)]]
    cluster = bounds = since = None
    counts = []
    for _ in range(12):
        count = {}
        cluster, best, bounds, since = centroids.reassign(vectors, cluster, bounds, since, history, count)
        every = ((vectors[:, None] - history[-1]) ** 2).sum(axis=2)
        assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
        then = np.stack([np.sqrt(((vectors - np.stack(history)[since[:, j], j]) ** 2).sum(axis=1)) for j in range(8)], axis=1)
        assert (bounds <= then).all()  # against the centroids of the round that measured them
        counts.append(count["measured"])
        history.append(np.stack([vectors[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) for j in range(8)]))
    assert counts[0] == 800 * 8 and counts[-1] < 800 * 3  # measured less and less
    # one displacement is never longer than the sum of its moves
    moves = [np.linalg.norm(b - a, axis=1) for a, b in zip(history, history[1:])]
    assert (np.linalg.norm(history[-1] - history[0], axis=1) <= sum(moves) + 1e-9).all()


def test_large_cells_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-(2**24), 2**24, 3)]) for i in range(30)] + [(100, [1.0e7, 1.0, 0.0]), (101, [1.0e7, 1.0, 0.0])]
    got, centres, _ = run(spark, rows, k=5, dims=3, rounds=2)
    assert (got, centres) == brute(rows, 5, 3, 2)
    apart = [(1, [2.0**45, 0.0, 0.0]), (2, [0.0, 1.0, -(2.0**45)])]
    got, centres, _ = run(spark, apart, k=2, dims=3, rounds=1)
    assert (got, centres) == brute(apart, 2, 3, 1)  # the distance between them does not fit a long
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1.0e30, 0.0, 0.0])], k=1, dims=3)


def test_few_or_no_rows(spark):
    assert run(spark, [], k=4, dims=2)[:2] == ([], [])
    assert run(spark, [(None, [1.0, 2.0])], k=4, dims=2)[:2] == ([], [])
    got, centres, df = run(spark, [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-1.0, 0.015])], k=4, dims=2)
    assert (got, centres) == brute([(7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-1.0, 0.015])], 4, 2, 3)
    told = centroids.with_inertia(df, centres).collect()
    assert {r.inertia for r in told} == {sum(d for _, _, d in got)}
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest() for r in told)
