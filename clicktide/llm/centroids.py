"""Exact k-means over integer vectors, with ns-bounds.

A vector keeps, for every centroid, a lower bound of its distance from the round
that last measured it.  The history of all centroids is kept, so in a later round
that bound is loosened by the norm of the centroid's whole displacement since then,
which is at most the sum of its moves of single rounds.  Centroids whose loosened
bound lies above the distance to the assigned one are passed over; the others
are measured again, exactly, in whole numbers.

A round reads the table of vectors and bounds and writes the next one.  Sums and
counts per cluster are added up by Spark; the driver sees one row per cluster.
"""

from decimal import ROUND_FLOOR, Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import materialize

_STATE = "vec_id long, cells binary, cluster int, bounds binary, since binary"
LARGEST_CELL = 2**62


# --- whole numbers ----------------------------------------------------------


def quantise(vectors: DataFrame, dims: int, scale: float, id_column="vec_id", vector_column="embedding") -> DataFrame:
    """``vec_id, cells``: floor(scale * x) of the components, packed at the narrowest width of 1, 2, 4 or 8 bytes.

    Null vectors, those without exactly ``dims`` components and those with a null or
    non-finite one are left out.  A cell of 2**62 or more is an error.
    """
    given = vectors.select(
        vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].cast("array<double>").alias("vector")
    ).where(F.size("vector") == dims)
    return given.where("NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))").mapInArrow(
        partial(_quantise, dims=dims, scale=scale), "vec_id long, cells binary"
    )


def _quantise(batches, dims, scale):
    for batch in batches:
        flat = np.floor(scale * batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
        most = np.abs(flat).max(axis=1, initial=0)
        if (most >= LARGEST_CELL).any():
            raise ValueError("a component is too large to be quantised")
        width = np.select([most < 2**7, most < 2**15, most < 2**31], [1, 2, 4], 8)
        cells = [row.astype(f"<i{w}").tobytes() for row, w in zip(flat, width)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cells, pa.binary())], ["vec_id", "cells"])


def _unpacked(cells: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch as rows of int64."""
    raw = cells.to_pylist()
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // dims
    out = np.empty((len(raw), dims), np.int64)
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        out[rows] = np.frombuffer(b"".join(raw[i] for i in rows), f"<i{width}").reshape(-1, dims)
    return out


def squared_distances(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows to one point: int64, or Python integers where those may overflow."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centre).max(initial=0)))
    if vectors.shape[1] * (2 * most) ** 2 < 2**63:
        rest = vectors - centre
        return np.einsum("ij,ij->i", rest, rest)
    rest = vectors.astype(object) - centre.astype(object)
    return (rest * rest).sum(axis=1)


# --- bounds -----------------------------------------------------------------


def _below(values) -> np.ndarray:
    """Doubles rounded down to floats."""
    told = np.asarray(values, np.float64) * (1 - 1e-12)
    return np.nextafter(told.astype(np.float32), np.float32(-np.inf))


def reassign(vectors, cluster, bounds, since, history, count=None):
    """Clusters, their exact squared distances, bounds and their rounds after the newest centroids of ``history``.

    ``bounds[i, j]`` is a lower bound of the distance of vector i to the centroid j
    of round ``since[i, j]``; ``count`` is told how many distances were measured.
    """
    now, n, k = len(history) - 1, len(vectors), len(history[0])
    if cluster is None:  # nothing is known: all distances are measured
        cluster = np.zeros(n, np.int64)
        bounds, since = np.zeros((n, k), np.float32), np.zeros((n, k), np.uint8)
        loose = np.full((n, k), -1.0)
    else:
        bounds, since = bounds.copy(), since.copy()
        moved = np.array(
            [[np.sqrt(float(squared_distances(old[None, j], history[now][j])[0])) for j in range(k)] for old in history]
        )
        loose = bounds - moved[since, np.arange(k)] * (1 + 1e-12)
    best = np.zeros(n, object)
    for j in range(k):  # the assigned centroid first
        rows = np.flatnonzero(cluster == j)
        best[rows] = squared_distances(vectors[rows], history[now][j])
    own = np.sqrt(best.astype(np.float64))
    bounds[np.arange(n), cluster], since[np.arange(n), cluster] = _below(own), now
    reach, nearest, measured = own * (1 + 1e-12), cluster.copy(), n
    for j in range(k):
        rows = np.flatnonzero((loose[:, j] <= reach) & (cluster != j))
        if len(rows):
            told = squared_distances(vectors[rows], history[now][j])
            bounds[rows, j], since[rows, j] = _below(np.sqrt(told.astype(np.float64))), now
            closer = (told < best[rows]) | ((told == best[rows]) & (j < nearest[rows]))
            best[rows[closer]], nearest[rows[closer]] = told[closer], j
            measured += len(rows)
    if count is not None:
        count.update(measured=measured, possible=n * k)
    return nearest, best, bounds, since


def _assign(batches, dims, history, final):
    centres = [np.array(c, np.int64) for c in history]
    k = len(centres[0])
    for batch in batches:
        vectors = _unpacked(batch.column("cells"), dims)
        cluster = bounds = since = None
        if "cluster" in batch.schema.names:
            cluster = batch.column("cluster").to_numpy().astype(np.int64)
            bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), "<f4").reshape(-1, k)
            since = np.frombuffer(b"".join(batch.column("since").to_pylist()), np.uint8).reshape(-1, k)
        nearest, best, bounds, since = reassign(vectors, cluster, bounds, since, centres)
        told = {"vec_id": batch.column("vec_id"), "cluster": pa.array(nearest.astype(np.int32))}
        if final:
            told["distance"] = pa.array([int(d) for d in best], pa.int64())  # an error beyond a long
        else:
            told["cells"] = batch.column("cells")
            told["bounds"] = pa.array([row.tobytes() for row in bounds.astype("<f4")], pa.binary())
            told["since"] = pa.array([row.tobytes() for row in since], pa.binary())
            told = {name: told[name] for name in ("vec_id", "cells", "cluster", "bounds", "since")}
        yield pa.RecordBatch.from_pydict(told)


def _partial_sums(batches, dims, k):
    """A row per cluster and task with the sum of every component; partial sums are whole numbers of any size."""
    sums, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
    for batch in batches:
        vectors, cluster = _unpacked(batch.column("cells"), dims), batch.column("cluster").to_numpy()
        small = int(np.abs(vectors).max(initial=0)) * len(vectors) < 2**63
        for j in np.unique(cluster):
            rows = vectors[cluster == j]
            sums[j] += (rows if small else rows.astype(object)).sum(axis=0)
            counts[j] += len(rows)
    there = np.flatnonzero(counts)
    places = pa.array([list(range(dims))] * len(there), pa.list_(pa.int32()))
    told = pa.array([[Decimal(int(s)) for s in sums[j]] for j in there], pa.list_(pa.decimal128(38, 0)))
    yield pa.RecordBatch.from_pydict(
        {"cluster": pa.array(there, pa.int32()), "place": places, "total": told, "n": pa.array(counts[there], pa.int64())}
    )


def new_centroids(state: DataFrame, old: list[list[int]], dims: int) -> list[list[int]]:
    """floor(sum / count) of every component; a centroid without vectors stays."""
    partials = state.select("cells", "cluster").mapInArrow(
        partial(_partial_sums, dims=dims, k=len(old)), "cluster int, place array<int>, total array<decimal(38,0)>, n long"
    )
    each = partials.select("cluster", "n", F.explode(F.arrays_zip("place", "total")).alias("c"))
    sums = each.groupBy("cluster", "c.place").agg(F.sum("c.total").alias("total"), F.sum("n").alias("n"))
    new = [list(c) for c in old]
    for row in sums.collect():  # clusters times components
        new[row["cluster"]][row["place"]] = int(row["total"]) // row["n"]
    return new


# --- the rounds -------------------------------------------------------------


def seeds(cells: DataFrame, k: int, order: Column, dims: int) -> list[list[int]]:
    """The ``k`` vectors that come first in ``order`` (ties by their cells); rows where it is null are none."""
    first = cells.withColumn("_order", order).where("_order IS NOT NULL").orderBy("_order", "cells").limit(k)
    return _unpacked(pa.array([r.cells for r in first.select("cells").collect()], pa.binary()), dims).tolist()


def cluster_vectors(
    vectors: DataFrame, order: Column, k: int = 16, dims: int = 64, scale: float = 64.0, rounds: int = 3
) -> tuple[DataFrame, list[list[int]]]:
    """Clusters after ``rounds`` rounds, and the final centroids.

    ``vectors`` needs ``vec_id`` and ``embedding``; see :func:`quantise` for those left
    out.  The first centroids are the ``k`` kept vectors that come first in ``order``,
    a column over ``vec_id``.  Each round assigns every vector to the nearest centroid
    (squared Euclidean distance, ties to the smaller number) and replaces each
    centroid that has vectors by the floor of their mean.

    Returns ``vec_id, cluster, distance`` for every kept row, repeated ones and rows
    without an id included (those are never first centroids), and the centroids.
    Fewer than ``k`` vectors make fewer centroids; an empty table has none and no row.
    A distance to the own centroid that a long cannot hold is an error.
    """
    state = quantise(vectors, dims, scale)
    centres = seeds(state, k, order, dims)
    spark = vectors.sparkSession
    if not centres:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    history = [centres]
    for _ in range(rounds):
        state = materialize(state.mapInArrow(partial(_assign, dims=dims, history=history, final=False), _STATE), "bounds")
        history.append(new_centroids(state, history[-1], dims))
    last = state.mapInArrow(
        partial(_assign, dims=dims, history=history, final=True), "vec_id long, cluster int, distance long"
    )
    return materialize(last, "clusters"), history[-1]


def with_inertia(clusters: DataFrame, centres: list[list[int]]) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` (of the components as decimal integers, comma-joined)."""
    spark = clusters.sparkSession
    of_cluster = clusters.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    rows = [(r.cluster, r.s) for r in of_cluster.collect()]  # one per cluster
    total = sum((s for _, s in rows), Decimal(0)).to_integral_value(ROUND_FLOOR)
    told = spark.createDataFrame(
        [(c, int(s), int(total), ",".join(map(str, centres[c]))) for c, s in rows],
        "cluster int, cluster_inertia long, inertia long, components string",
    )
    told = told.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return clusters.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k=16, dims=64, scale=64, rounds=3) -> str:
    steps = [f"""
kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INT AS cluster, v AS c FROM kept
  WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), v LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT vec_id, v, min(struct_pack(d := d, cluster := cluster)) AS best FROM (
    SELECT r, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM (SELECT row_number() OVER () AS r, vec_id, v FROM kept), c{i}) GROUP BY r, vec_id, v)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (
  SELECT cluster, list((s - ((s % n + n) % n)) // n ORDER BY place) AS c FROM (
    SELECT best.cluster AS cluster, place, sum(v[place])::HUGEINT AS s, count(*)::HUGEINT AS n
    FROM (SELECT best, v, unnest(range(1, {dims + 1})) AS place FROM a{i}) GROUP BY best.cluster, place) GROUP BY cluster),
c{i + 1} AS (SELECT cluster, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (cluster))""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, best.cluster AS cluster, best.d::BIGINT AS distance,
  (sum(best.d) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON cluster = best.cluster"""


ORACLE = _oracle()
