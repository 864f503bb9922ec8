"""Packing documents into sequences of one window, by lengths.

Every document is cut into full windows and one shorter rest.  Only the number
of rests of each length matters for the plan: combinations of two or three
lengths that fill the window exactly are enumerated, their repeat counts solved
by non-negative least squares against that histogram and rounded down to what is
there.  What remains is laid end to end in order of length and cut at the window;
the last, shorter stretch is cut into powers of two, which need no padding.

The plan is as large as the number of combinations, whatever the number of
documents.  A rest finds its place by its rank among the rests of its length.
The rank is the sum of a count within the task that encoded it and of the counts
of the tasks before, so no length is gathered in one task.
"""

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktide.llm.common import documents, new_path
from clicktide.llm.tokens import word_encoder


# --- the plan ---------------------------------------------------------------


@dataclass
class Plan:
    """Where the rests of each length go.

    ``slots`` has, by length and first rank: rests of a length from that rank on
    fill a combination's places (``per`` of them in each sequence, from ``offset``)
    from sequence ``sequence`` on.  ``tape`` has for each length the first rank
    that is laid end to end and its place on the tape.
    """

    window: int
    full: int
    slots: np.ndarray
    tape_rank: np.ndarray
    tape_place: np.ndarray
    tape_sequence: int
    tape_cuts: np.ndarray

    @property
    def sequences(self) -> int:
        return self.tape_sequence + len(self.tape_cuts) - 1 + int(self.tape_cuts[0]) // self.window


_SLOT = np.dtype([("length", "i8"), ("rank", "i8"), ("sequence", "i8"), ("per", "i8"), ("offset", "i8")])


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All ways to fill ``window`` with two or three of ``lengths``, as rows with 0 for no third."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    made = []
    for a in np.sort(lengths):
        if 2 * a <= window and there[window - a]:
            made.append([[window - a, a, 0]])
        b = np.arange(a, (window - a) // 2 + 1)
        c = window - a - b
        fits = there[b] & (c > 0) & there[c]
        if fits.any():
            made.append(np.stack([c[fits], b[fits], np.full(fits.sum(), a)], axis=1))
    return np.concatenate(made).astype(np.int64) if made else np.empty((0, 3), np.int64)


def solve_counts(ways: np.ndarray, histogram: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Non-negative least squares: repeats of each way so that the lengths add up to the histogram."""
    n = len(histogram)

    def used(x):
        total = sum(np.bincount(ways[:, k], x, n) for k in range(3))
        total[0] = 0
        return total

    def toward(r):
        r = r.copy()
        r[0] = 0
        return r[ways].sum(axis=1)

    x = np.zeros(len(ways))
    if not len(ways):
        return x
    probe = np.ones(len(ways))
    for _ in range(20):  # the largest eigenvalue bounds the step
        image = toward(used(probe))
        bound = np.linalg.norm(image) / np.linalg.norm(probe)
        probe = image / np.linalg.norm(image)
    point, momentum = x, 1.0
    for _ in range(rounds):  # accelerated projected gradient
        new = np.maximum(point - toward(used(point) - histogram) / (1.01 * bound), 0)
        next_momentum = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        point = new + (momentum - 1) / next_momentum * (new - x)
        x, momentum = new, next_momentum
    return x


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """``histogram[l]``: number of pieces of length l, up to the window."""
    left = histogram.astype(np.int64).copy()
    full = int(left[window])
    left[window] = 0
    taken = np.zeros_like(left)
    ways = combinations(np.flatnonzero(left), window)
    wanted = solve_counts(ways, left.astype(float))
    sequence, slots = full, []
    for i in np.argsort(-wanted, kind="stable"):
        if wanted[i] <= 0:
            break
        way = [int(v) for v in ways[i] if v]
        per = {v: way.count(v) for v in way}
        repeats = min(int(np.ceil(wanted[i])), *(int(left[v]) // m for v, m in per.items()))
        if repeats:
            offset = 0
            for v, m in per.items():
                slots.append((v, taken[v], sequence, m, offset))
                offset += v * m
                taken[v] += m * repeats
                left[v] -= m * repeats
            sequence += repeats
    lengths = np.arange(window + 1)
    stretch = left * lengths
    place = np.cumsum(stretch) - stretch
    total = int(stretch.sum())
    cuts = [total - total % window]  # then the powers of two of the rest
    for bit in reversed(range(window.bit_length())):
        if (total - cuts[-1]) >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    ordered = np.sort(np.array(slots, _SLOT), order=["length", "rank"])
    return Plan(window, full, ordered, taken, place, sequence, np.array(cuts))


def place_piece(plan: Plan, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """``(start within the piece, length, sequence, offset)`` of the parts of a piece."""
    if length == plan.window:
        return [(0, length, rank, 0)]
    if rank < plan.tape_rank[length]:
        first, last = np.searchsorted(plan.slots["length"], [length, length + 1])
        at = first + np.searchsorted(plan.slots["rank"][first:last], rank, side="right") - 1
        slot = plan.slots[at]
        turn, copy = divmod(rank - int(slot["rank"]), int(slot["per"]))
        return [(0, length, int(slot["sequence"]) + turn, int(slot["offset"]) + copy * length)]
    at = int(plan.tape_place[length]) + (rank - int(plan.tape_rank[length])) * length
    parts, done, whole = [], 0, int(plan.tape_cuts[0])
    while done < length:
        here = at + done
        if here < whole:
            sequence, offset = divmod(here, plan.window)
            room = plan.window - offset
        else:
            step = int(np.searchsorted(plan.tape_cuts, here, side="right")) - 1
            sequence, offset = whole // plan.window + step, here - int(plan.tape_cuts[step])
            room = int(plan.tape_cuts[step + 1]) - here
        part = min(room, length - done)
        parts.append((done, part, plan.tape_sequence + sequence, offset))
        done += part
    return parts


# --- the jobs ---------------------------------------------------------------


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = 2048,
    latin_runs: bool = True,
    with_ids: bool = True,
) -> DataFrame:
    """Encode every text, add ``end_id`` and pack the ids into sequences of ``window``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read.  A null or
    empty text has the end id alone.  Rows without an id and repeated ids are
    packed one by one.  An empty table gives no row.

    Returns a row per piece: ``doc_id, start`` (ids of its document before it),
    ``length, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids`` (packed
    little-endian, 32 bits).  Sequences are full windows; the last few have a power
    of two of ids.
    """
    if window & (window - 1):
        raise ValueError("the window has to be a power of two")
    spark = docs.sparkSession
    path = new_path(spark, "pieces")
    cut = documents(docs).mapInArrow(
        partial(_cut_documents, tokenizer=tokenizer, end_id=end_id, window=window, latin_runs=latin_runs),
        "part int, length int, place long, doc_id long, start long, doc_tokens long, ids binary",
    )
    cut.write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(cut.schema).parquet(path)
    counts = pieces.groupBy("part", "length").agg((F.max("place") + 1).alias("n"))
    counted = new_path(spark, "piece-counts")
    counts.write.parquet(counted)
    counts = spark.read.schema(counts.schema).parquet(counted)
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one per length
        histogram[row["length"]] = row["n"]
    plan = make_plan(histogram, window)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select(
        "doc_id", "start", "doc_tokens", "length", (F.col("before") + F.col("place")).alias("rank"), "ids"
    )
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(
        partial(_place_pieces, plan=plan, with_ids=with_ids), schema + (", ids binary" if with_ids else "")
    )


_PIECES = pa.schema(
    [("part", pa.int32()), ("length", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()),
     ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
)


def _cut_documents(batches, tokenizer, end_id, window, latin_runs):
    encoder = word_encoder(tokenizer, latin_runs)
    end = int(end_id).to_bytes(4, "little")
    narrow = max(encoder.library.get_vocab_size(), end_id + 1) <= 1 << 16
    part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
    for batch in batches:
        texts, rows, held = batch.column("text"), [], 0
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            ids = np.frombuffer(encoder.encode(texts[i].as_py()) + end, "<u4")
            for start in range(0, len(ids), window):
                piece = ids[start : start + window]
                n = len(piece)
                packed = (piece.astype("<u2") if narrow else piece).tobytes()
                rows.append((part, n, int(seen[n]), doc_id, start, len(ids), packed))
                seen[n] += 1
                held += len(packed)
            if held > 16 << 20:
                yield _batch(rows, _PIECES)
                rows, held = [], 0
        if rows:
            yield _batch(rows, _PIECES)


def _batch(rows, schema):
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


_PLACED = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


def _place_pieces(batches, plan, with_ids):
    schema = _PLACED.append(pa.field("ids", pa.binary())) if with_ids else _PLACED
    for batch in batches:
        rows = []
        for doc_id, start, tokens, length, rank, raw in zip(*(c.to_pylist() for c in batch.columns)):
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4").astype("<u4")
            for begin, n, sequence, offset in place_piece(plan, length, rank):
                packed = ids[begin : begin + n].tobytes()
                row = (doc_id, start + begin, n, zlib.crc32(packed), tokens, sequence, offset)
                rows.append(row + ((packed,) if with_ids else ()))
        if rows:
            yield _batch(rows, schema)
