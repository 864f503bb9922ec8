"""Exact top-k search by integer inner product, over buckets of vectors of like length.

Vectors are ordered by length and cut into buckets.  A query with a score ``t``
that its k best must reach needs, in a bucket whose longest vector has length
``l``, a cosine of at least ``t / (|q| l)``: above 1 the bucket is skipped.  At a
high local threshold the query's largest coordinates bound those of a candidate
(coordinate pruning), at a low one only vectors that are long enough are looked
at (length pruning).  What is left is verified by its product.  Queries go over
the buckets in blocks.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktide.llm.common import materialize, shuffle_partitions

COORDINATE_FROM = 0.75  # local cosine threshold from which coordinates prune
FOCUS = 3  # coordinates looked at
_SLACK = 1e-9  # for rounding in lengths and cosines; only ever admits more candidates


# --- quantised vectors ------------------------------------------------------


def quantise(vectors: DataFrame, scale: float = 256.0, id_column="vec_id", vector_column="embedding") -> DataFrame:
    """``vec_id, length, dims, cells``: floor(scale * x) of every component.

    Cells are packed as 32-bit integers or, where one of a vector does not fit,
    as doubles, which hold any such integer exactly.  Rows without an id, null
    vectors and vectors with null or non-finite components are left out.  A finite
    component whose cell exceeds the range of doubles is an error.
    """
    given = vectors.select(
        vectors[id_column].cast("long").alias("vec_id"),
        vectors[vector_column].cast("array<double>").alias("vector"),
    ).where("vec_id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    return given.mapInArrow(partial(_quantise, scale=scale), "vec_id long, length double, dims int, cells binary")


def _norm(cells) -> float:
    most = np.abs(cells).max(initial=0.0)
    return float(most * np.sqrt(np.square(cells / most).sum())) if most > 1e150 else float(np.sqrt(cells @ cells))


def _quantise(batches, scale):
    for batch in batches:
        lists = batch.column("vector").combine_chunks() if hasattr(batch.column("vector"), "combine_chunks") else batch.column("vector")
        given = lists.flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(scale * given)
            if (np.isfinite(given) & ~np.isfinite(flat)).any():
                raise ValueError("a component is too large to be quantised")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            sums = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(flat), 0, 1))])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            ends = ends.astype(np.int64)
        rows = []
        for vec_id, a, b in zip(batch.column("vec_id").to_pylist(), starts, ends):
            if sums[b] == sums[a]:
                cells = flat[a:b]
                narrow = np.abs(cells).max(initial=0.0) < 2.0**31
                rows.append((vec_id, _norm(cells), int(b - a), cells.astype("<i4" if narrow else "<f8").tobytes()))
        if rows:
            ids, lengths, dims, cells = zip(*rows)
            yield pa.RecordBatch.from_pydict(
                {"vec_id": pa.array(ids, pa.int64()), "length": pa.array(lengths, pa.float64()),
                 "dims": pa.array(dims, pa.int32()), "cells": pa.array(cells, pa.binary())}
            )


# --- blocks -----------------------------------------------------------------

_BLOCK_SCHEMA = "block long, longest double, ids binary, lengths binary, dims int, cells binary"


def _pack(batches, rows_per_block):
    """Consecutive rows as blocks: a matrix as wide as the longest row, shorter rows end in zeros."""
    part, seq, held = TaskContext.get().partitionId(), 0, []

    def block():
        ids, lengths, widths, cells = zip(*held)
        dims = max(widths)
        kinds = ["<f8" if len(raw) > 4 * n else "<i4" for raw, n in zip(cells, widths)]
        matrix = np.zeros((len(held), dims), "<f8" if "<f8" in kinds else "<i4")
        for row, raw, n, kind in zip(matrix, cells, widths, kinds):
            row[:n] = np.frombuffer(raw, kind)
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([part << 32 | seq], pa.int64()), "longest": [max(lengths)],
             "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
             "lengths": pa.array([np.array(lengths, "<f8").tobytes()], pa.binary()),
             "dims": pa.array([dims], pa.int32()), "cells": pa.array([matrix.tobytes()], pa.binary())}
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "length", "dims", "cells"))):
            held.append(row)
            if len(held) == rows_per_block:
                yield block()
                seq, held = seq + 1, []
    if held:
        yield block()


def _matrix(raw, n, dims, width):
    cells = np.frombuffer(raw, "<f8" if len(raw) > 4 * n * dims else "<i4").reshape(n, dims)
    return np.pad(cells, ((0, 0), (0, width - dims))) if width > dims else cells


# --- one block of queries against one bucket --------------------------------


NO_LONG = 2**63 - 1  # stands for any score beyond the range of a long


def _whole_numbers(cells):
    """The cells as Python integers, whose products never overflow."""
    made = np.empty(cells.shape, object)
    made[:] = [[int(x) for x in row] for row in cells]
    return made


def _not_above(score: int) -> float:
    """The score as a double, rounded down."""
    told = float(score)
    return told if int(told) <= score else float(np.nextafter(told, -np.inf))


def search_bucket(queries, query_lengths, least, vectors, lengths, k, query_ids, ids, count=None):
    """``(query row, vector row, score)`` of the ``k`` best of each query that reach ``least``; scores are exact.

    ``lengths`` of the bucket descend.  ``least`` may be -inf.  A vector with the
    query's own id takes no part.  ``count`` is told how each query was pruned.
    """
    found = []
    real = queries.astype(np.float64)
    exact = vectors.astype(np.float64)
    # sums stay below the product of the lengths, so doubles hold them exactly up to 2**53 and longs up to 2**63
    most = query_lengths.max(initial=0) * lengths.max(initial=0)
    cells = max(np.abs(real).max(initial=0), np.abs(exact).max(initial=0))
    if most < 2**53:
        q_cells, v_cells = real, exact
    elif most < 2**62 and cells < 2**62:
        q_cells, v_cells = queries.astype(np.int64), vectors.astype(np.int64)
    else:
        q_cells, v_cells = _whole_numbers(queries), _whole_numbers(vectors)
    need = np.divide(least, query_lengths, out=np.full(len(queries), -np.inf), where=query_lengths > 0)
    need = np.where(query_lengths > 0, need, np.where(least > 0, np.inf, -np.inf))
    local = need / max(lengths[0], 1e-300) if len(lengths) else need
    skipped = local > 1 + _SLACK
    by_coordinate = ~skipped & (local >= COORDINATE_FROM)
    by_length = ~skipped & ~by_coordinate
    if count is not None:
        count.update(skipped=int(skipped.sum()), coordinate=int(by_coordinate.sum()), length=int(by_length.sum()))

    def take(row, candidates, scores):
        own = ids[candidates] != query_ids[row]
        candidates, scores = candidates[own], scores[own]
        enough = scores >= least[row]
        candidates, scores = candidates[enough], scores[enough]
        if scores.dtype == object:
            best = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[candidates[i]]))[:k]
            found.extend((row, int(candidates[i]), max(-NO_LONG, min(NO_LONG, scores[i]))) for i in best)
            return
        if len(scores) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= edge
            candidates, scores = candidates[keep], scores[keep]
        best = np.lexsort((ids[candidates], -scores))[:k]
        found.extend((row, int(candidates[i]), int(scores[i])) for i in best)

    rows = np.flatnonzero(by_length)
    if len(rows):
        # lengths descend: those long enough for any of these queries are a prefix
        reach = need[rows] * (1 - _SLACK)
        upto = np.searchsorted(-lengths, -np.minimum(reach, lengths[0]), side="right")
        upto = np.where(reach <= 0, len(lengths), upto)
        widest = int(upto.max())
        products = q_cells[rows] @ v_cells[:widest].T
        for row, n, scores in zip(rows, upto, products):
            take(row, np.arange(n), scores[:n])
    rows = np.flatnonzero(by_coordinate)
    if len(rows):
        unit = exact / np.maximum(lengths, 1e-300)[:, None]
        order = {}
        for row in rows:
            cosine = min(local[row] * (1 - _SLACK), 1.0)
            direction = real[row] / query_lengths[row]
            alive = None
            for f in np.argsort(-np.abs(direction))[:FOCUS]:
                middle = direction[f] * cosine
                spread = ((1 - cosine**2) * max(1 - direction[f] ** 2, 0.0)) ** 0.5
                low, high = middle - spread - _SLACK, middle + spread + _SLACK
                # a coordinate that points the query's way may exceed the range only if the cosine does
                if direction[f] >= cosine:
                    high = 1 + _SLACK
                if direction[f] <= -cosine:
                    low = -1 - _SLACK
                if f not in order:
                    by = np.argsort(unit[:, f], kind="stable")
                    order[f] = by, unit[by, f]
                by, values = order[f]
                inside = by[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]
                alive = inside if alive is None else np.intersect1d(alive, inside, assume_unique=True)
            if len(alive):
                take(row, alive, v_cells[alive] @ q_cells[row])
    return found


def _seed_thresholds(batches, k):
    """Adds to each query block the k-th best score within the longest bucket, a bound from below."""
    for batch in batches:
        for row in batch.to_pylist():
            width = max(row["dims"], row["v_dims"] or 0)
            ids, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<f8")
            v_ids, v_lengths = np.frombuffer(row["v_ids"], "<i8"), np.frombuffer(row["v_lengths"], "<f8")
            queries = _matrix(row["cells"], len(ids), row["dims"], width)
            vectors = _matrix(row["v_cells"], len(v_ids), row["v_dims"], width)
            least = np.full(len(ids), -np.inf)
            scores: dict[int, list[int]] = {}
            for at, _, score in search_bucket(queries, lengths, least, vectors, v_lengths, k, ids, v_ids):
                scores.setdefault(at, []).append(score)
            for at, best in scores.items():
                if len(best) == k:
                    least[at] = _not_above(min(best))
            # a bucket can matter to the block if it holds a vector of this length
            need = np.where(lengths > 0, least / np.maximum(lengths, 1e-300), np.where(least > 0, np.inf, -np.inf))
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([row["block"]], pa.int64()), "need": pa.array([float(need.min())], pa.float64()),
                 "ids": pa.array([row["ids"]], pa.binary()), "lengths": pa.array([row["lengths"]], pa.binary()),
                 "least": pa.array([least.tobytes()], pa.binary()), "dims": pa.array([row["dims"]], pa.int32()),
                 "cells": pa.array([row["cells"]], pa.binary())}
            )


def _search_pairs(batches, k):
    for batch in batches:
        for row in batch.to_pylist():
            width = max(row["dims"], row["v_dims"])
            ids, v_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["v_ids"], "<i8")
            found = search_bucket(
                _matrix(row["cells"], len(ids), row["dims"], width), np.frombuffer(row["lengths"], "<f8"),
                np.frombuffer(row["least"], "<f8"), _matrix(row["v_cells"], len(v_ids), row["v_dims"], width),
                np.frombuffer(row["v_lengths"], "<f8"), k, ids, v_ids,
            )
            if found:
                at, vector, score = zip(*found)
                yield pa.RecordBatch.from_pydict(
                    {"query_id": pa.array(ids[list(at)]), "vec_id": pa.array(v_ids[list(vector)]), "score": pa.array(score, pa.int64())}
                )


# --- the search -------------------------------------------------------------


def top_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    bucket_rows: int = 1024,
    query_rows: int = 512,
) -> DataFrame:
    """The ``k`` best scores of every query among all other vectors: ``query_id, rank, vec_id, score``.

    ``vectors`` needs ``vec_id`` and ``embedding``; ``is_query`` is a condition on
    ``vec_id``.  Ties go to the smaller ``vec_id``.  See ``quantise`` for the
    vectors that take no part.  Vectors of different width are compared as if the
    shorter one ended in zeros.  Rows that share an id are each other's own rows
    and never in each other's result.  Without queries or other vectors there is
    no row.  Vectors may have any length and number of components; a score of the
    result that a long cannot hold is an error.
    """
    spark = vectors.sparkSession
    cells = materialize(quantise(vectors, scale), "quantised")
    order = [F.desc("length"), F.asc("vec_id")]  # equal lengths are shared out by id
    buckets = materialize(
        cells.repartitionByRange(shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(partial(_pack, rows_per_block=bucket_rows), _BLOCK_SCHEMA),
        "length-buckets",
    )
    of_bucket = [F.col(c).alias(f"v_{c}") for c in ("block", "ids", "lengths", "dims", "cells")]
    # one block, at most bucket_rows vectors
    longest = buckets.orderBy(F.desc("longest"), "block").limit(1).select(*of_bucket)
    queries = cells.where(is_query)
    # no more tasks than the queries fill
    tasks = min(shuffle_partitions(spark), 1 + queries.count() // query_rows)
    blocks = queries.repartition(tasks).mapInArrow(partial(_pack, rows_per_block=query_rows), _BLOCK_SCHEMA)
    blocks = materialize(
        blocks.join(F.broadcast(longest)).mapInArrow(
            partial(_seed_thresholds, k=k),
            "block long, need double, ids binary, lengths binary, least binary, dims int, cells binary",
        ),
        "query-blocks",
    )
    # pairs of block numbers only; blocks no query can profit from are left out
    pairs = blocks.select("block", "need").join(
        buckets.select(F.col("block").alias("v_block"), "longest"),
        F.col("need") <= F.col("longest") * (1 + _SLACK),
    )
    work = (
        pairs.select("block", "v_block")
        .join(blocks.drop("need"), "block")
        .join(buckets.select(*of_bucket), "v_block")
    )
    found = work.mapInArrow(partial(_search_pairs, k=k), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    too_large = F.raise_error(F.lit("a score exceeds the range of a long")).cast("long")
    return (
        best.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", F.when(F.abs("score") == NO_LONG, too_large).otherwise(F.col("score")).alias("score"))
    )
