"""Similarity join on word shingles in the metric space of the Jaccard distance.

Distances between unrelated documents are all close to 1, where pivots can't tell
documents apart.  So a first, exact step finds who can be near to whom at all:
linked documents share one of their first few shingles in a common order (rare
ones first).  Each shingle's documents form a group, its smallest document is the
pivot, and the groups of a pivot make up its region.

1. Every document of a region is compared with the pivot, first by size, then by
   counts in hash classes, which bound the distance from below, then exactly.
   Copies of a text thus link in a star, not in all pairs.
2. Regions that are not connected by that are joined within, in blocks.  By the
   triangle inequality a document further than twice the threshold from the pivot
   cannot be near the documents within the threshold of it, so only a window of
   boundary documents meets them.  Blocks are split by pivots of their own into
   Voronoi regions with such windows, again and again, until they are small.
   Pairs that are connected already are skipped; the others are verified exactly.

Counts travel only for documents that sizes leave over, sets only for pairs that the
counts leave over.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktide.llm import shingles as sh
from clicktide.llm.cache import hold
from clicktide.llm.common import by_ids, documents, materialize, shuffle_partitions
from clicktide.llm.components import components
from clicktide.plans.skew import lookup_join

FREQUENT = 1 << 18  # shingles told to be frequent; only the order of the others is less good
BLOCK = 512
SMALL = 48  # documents that are compared one by one
STAR = 64  # pairs of a pivot that its data is sent to at once
SORTED = 4096  # documents of a region that are put in order of size, at most


class Threshold:
    """A similarity of ``num / den`` in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        """First shingles of which a linked document holds one at least."""
        return n - -(-n * self.num // self.den) + 1

    def may_link(self, difference, size):
        """Whether sets of ``size`` together that differ in at least ``difference`` can be near enough."""
        return (self.den + self.num) * difference <= (self.den - self.num) * size

    def links(self, both, size):
        return self.den * both >= self.num * (size - both)

    def beyond(self, difference, size):
        """Whether their distance is more than twice the threshold's."""
        # 1 - (size - difference) / (size + difference) > 2 (1 - num / den)
        return 2 * difference * self.den > 2 * (self.den - self.num) * (size + difference)


# --- one pass for sizes and frequent shingles, one for what is compared -------

_SIZES = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("shingle", pa.int64()), ("times", pa.int64())]
)


def _slices(batch, rows=1024):
    hold(_slices)  # nothing is kept here; caches of other operators make room
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


COUNTED_AT_ONCE = 1 << 21  # shingles whose repeats are counted at a time (16 MB)


def _sizes(batches, width):
    """A row per document, and one per shingle that several documents of a stretch of rows hold."""

    def repeats():
        values, times = np.unique(np.concatenate(held), return_counts=True)
        values, times = values[times > 1].view(np.int64), times[times > 1]
        empty = pa.nulls(len(values), pa.int64())
        return pa.RecordBatch.from_arrays(
            [empty, empty, pa.nulls(len(values), pa.binary()), pa.array(values), pa.array(times.astype(np.int64))],
            schema=_SIZES,
        )

    held, size = [], 0
    for batch in batches:
        for part in _slices(batch):
            sets = sh.shingle_sets(part.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([sh.set_signature(s) for s in sets], pa.binary()),
                 pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64())],
                schema=_SIZES,
            )
            held += [s for s in sets if len(s)]
            size += sum(map(len, sets))
            if size > COUNTED_AT_ONCE:
                yield repeats()
                held, size = [], 0
    if held:
        yield repeats()


_KEYS = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("prefix", pa.list_(pa.int64())), ("counts", pa.binary())])


def _prefixes(batches, width, threshold, frequent, times):
    for batch in batches:
        for part in _slices(batch):
            rows = ([], [], [], [])
            for doc_id, s in zip(part.column("doc_id").to_pylist(), sh.shingle_sets(part.column("text").to_pylist(), width)):
                if not len(s):
                    continue
                k = threshold.prefix(len(s))
                common = np.zeros(len(s), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    common = np.where(frequent[at] == s, times[at], 0)
                first = s[np.lexsort((s, common))[:k]]
                for column, value in zip(rows, (doc_id, sh.set_signature(s), first.view(np.int64), sh.class_counts(s).tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _KEYS.types)], schema=_KEYS)


def _sets(batches, width):
    for batch in batches:
        for part in _slices(batch):
            sets = sh.shingle_sets(part.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                names=["doc_id", "data"],
            )


# --- comparing with pivots --------------------------------------------------


def _star(pairs: DataFrame, data: DataFrame, compare, schema: str) -> DataFrame:
    """``compare(pivot's data, x's data)`` for every pair ``(p, x)``.

    A pivot's data is sent once to each block of its pairs.
    """
    n = shuffle_partitions(pairs.sparkSession)
    blocks = _dealt(pairs, n)
    of = data.select(F.col("doc_id").alias("_id"), "data")
    each = blocks.join(of, F.col("x") == F.col("_id")).select("p", "block", F.lit(1).alias("turn"), "x", "data")
    heads = (
        blocks.select("p", "block").distinct().join(of, F.col("p") == F.col("_id"))
        .select("p", "block", F.lit(0).alias("turn"), F.col("p").alias("x"), "data")
    )
    dealt = each.unionByName(heads).repartition(n, "p", "block").sortWithinPartitions("p", "block", "turn")
    return dealt.mapInArrow(partial(_compare_star, compare=compare), schema)


def _dealt(pairs: DataFrame, n: int) -> DataFrame:
    """``(p, x, block)``: one block for about ``STAR`` pairs of a pivot, ``n`` at most, so that many pairs are shared out."""
    many = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("_pairs")).where(F.col("_pairs") > STAR)
    blocks = F.least(F.lit(n), F.ceil(F.coalesce("_pairs", F.lit(1)) / STAR))
    counted = lookup_join(pairs, many, "p", "_pairs", ["x"])
    return counted.select("p", "x", F.pmod(F.xxhash64("x"), blocks).alias("block"))


def _with_far(pairs: DataFrame, of: DataFrame, threshold: Threshold) -> DataFrame:
    """``(p, x, far)``: whether sizes alone tell that they are beyond twice the threshold.  ``of`` has the sizes of each id."""
    of = of.groupBy("doc_id").agg(F.min("n").alias("low"), F.max("n").alias("high"))  # rows that share an id have several

    def ends(side):
        return of.select(F.col("doc_id").alias(side), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}"))

    # the sizes that come nearest to each other, unless some are equal or between
    more, less = F.greatest("low_p", "low_x"), F.least("high_p", "high_x")
    far = (more > less) & threshold.beyond(more - less, more + less)
    return pairs.join(ends("p"), "p").join(ends("x"), "x").select("p", "x", far.alias("far"))


def _compare_star(batches, compare):
    key, heads = None, []
    for batch in batches:
        rows = []
        for p, block, turn, x, data in zip(*(c.to_pylist() for c in batch.columns)):
            if (p, block) != key:
                key, heads = (p, block), []
            if turn == 0:
                heads.append(data)  # rows that share an id have several
            else:
                found = [compare(head, data) for head in heads]
                rows.append((p, x, *[any(f[i] for f in found) for i in range(len(found[0]))]))
        if rows:
            columns = list(zip(*rows))
            names = ["p", "x", *(f"v{i}" for i in range(len(columns) - 2))]
            types = [pa.int64(), pa.int64(), *[pa.bool_()] * (len(columns) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _counts_compare(a, b, threshold):
    """Whether the counts leave a link possible, and whether they leave a distance within twice the threshold."""
    (n, x), (m, y) = _unpack(a), _unpack(b)
    difference = max(sh.least_difference(x, y), abs(n - m))
    return threshold.may_link(difference, n + m), not threshold.beyond(difference, n + m)


def _sets_compare(a, b, threshold):
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    return (threshold.links(sh.common(x, y), len(x) + len(y)),)


def _unpack(raw):
    """Size and class counts; the size stands before the counts."""
    return int.from_bytes(raw[:8], "little"), np.frombuffer(raw, np.uint8, offset=8)


def _verified(texts: DataFrame, pairs: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """Pairs whose sets are near enough; only the sets of documents in pairs are made."""
    ids = pairs.select(F.col("p").alias("doc_id")).union(pairs.select("x")).distinct()
    wanted = materialize(ids, "pair-ids")
    sets = by_ids(texts, wanted, "left_semi").mapInArrow(partial(_sets, width=width), "doc_id long, data binary")
    sets = materialize(sets, "pair-sets")
    told = _star(pairs, sets, partial(_sets_compare, threshold=threshold), "p long, x long, v0 boolean")
    return told.where("v0").select("p", "x")


# --- joining blocks of a region ---------------------------------------------


def near_pairs(sizes, counts, threshold: Threshold, left=None, right=None) -> set[tuple[int, int]]:
    """Index pairs whose class counts leave a link possible, smaller index first.

    Of one list, or of ``left`` against ``right``.
    """
    sizes = np.asarray(sizes)
    level = np.array([len(c) for c in counts])
    found: set[tuple[int, int]] = set()
    for classes in np.unique(level):
        # near documents differ little in size, so their levels by one step at most
        near = np.flatnonzero((level == classes) | (level == 2 * classes))
        rows = np.stack([sh.fold(counts[i], classes) for i in near])
        base = level[near] == classes
        if left is None:
            _regions(near, rows, sizes, base, threshold, found)
        else:
            sides = np.isin(near, left), np.isin(near, right)
            for a, b in (sides, sides[::-1]):
                one, other = np.flatnonzero(a & base), np.flatnonzero(b)
                _meet(near, rows, sizes, one, other, threshold, found)
    return found


def _meet(near, rows, sizes, one, other, threshold, found):
    """Every row of ``one`` with the rows of ``other`` of a like size."""
    if not len(one) or not len(other):
        return
    n = sizes[near[other]]
    order = np.argsort(n, kind="stable")
    other, n = other[order], n[order]
    for i in one:
        size = int(sizes[near[i]])
        a = np.searchsorted(n, -(-size * threshold.num // threshold.den), "left")
        b = np.searchsorted(n, size * threshold.den // max(1, threshold.num), "right")
        if a < b:
            difference = np.abs(rows[other[a:b]] - rows[i]).sum(axis=1)
            for j in other[a:b][threshold.may_link(difference, size + n[a:b])]:
                if i != j:
                    x, y = int(near[i]), int(near[j])
                    found.add((min(x, y), max(x, y)))


def _regions(near, rows, sizes, base, threshold, found, members=None):
    """Split by pivots while that makes the regions smaller, then compare within them.

    The distance is the difference of class counts, a metric.  Linked documents are
    within ``reach`` of each other, so a document is copied into every region whose
    pivot is at most ``2 reach`` further from it than its nearest one.
    """
    members = np.arange(len(near)) if members is None else members
    if len(members) > SMALL:
        n = sizes[near[members]]
        # (den + num) d <= (den - num) (n + m) bounds the distance of linked ones
        reach = 2 * int(n.max()) * (threshold.den - threshold.num) // (threshold.den + threshold.num)
        pivots = [members[0]]
        distance = np.abs(rows[members] - rows[pivots[0]]).sum(axis=1)[:, None]
        while len(pivots) < 8:  # the furthest from all so far
            pivots.append(members[int(distance.min(axis=1).argmax())])
            distance = np.column_stack([distance, np.abs(rows[members] - rows[pivots[-1]]).sum(axis=1)])
        window = distance <= distance.min(axis=1, keepdims=True) + 2 * reach
        home = distance.argmin(axis=1)
        parts = [members[window[:, k]] for k in range(len(pivots)) if (home == k).any()]
        if max(map(len, parts)) <= 0.8 * len(members) and sum(map(len, parts)) <= 2 * len(members):
            for part in parts:
                _regions(near, rows, sizes, base, threshold, found, part)
            return
    _meet(near, rows, sizes, members[base[members]], members, threshold, found)


def _join_blocks(batches, threshold):
    """Rows of one ``(p, i, j)`` follow each other; at most two blocks of documents are held."""
    key, held = None, []

    def done():
        xs, comps, blocks = (np.array(c) for c in zip(*[(x, c, b) for x, c, b, _ in held]))
        sizes, counts = zip(*[_unpack(d) for *_, d in held])
        _, i, j = key
        if i == j:
            found = near_pairs(sizes, counts, threshold)
        else:
            found = near_pairs(sizes, counts, threshold, np.flatnonzero(blocks == i), np.flatnonzero(blocks == j))
        rows = [(min(xs[a], xs[b]), max(xs[a], xs[b])) for a, b in found if comps[a] != comps[b] and xs[a] != xs[b]]
        p, x = (list(c) for c in zip(*rows)) if rows else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(x, pa.int64())], names=["p", "x"])

    for batch in batches:
        for p, i, j, x, comp, block, data in zip(*(c.to_pylist() for c in batch.columns)):
            if (p, i, j) != key:
                if held:
                    yield done()
                key, held = (p, i, j), []
            held.append((x, comp, block, data))
    if held:
        yield done()


def _met_by_size(dealt: DataFrame, of: DataFrame, threshold: Threshold) -> DataFrame:
    """Rows of regions without those that nothing else in their region is near enough to in size.

    Regions of more than ``SORTED`` rows are left as they are: they would be sorted in one task.
    """
    small = dealt.where(F.col("rows") <= SORTED)
    sized = small.select("p", "x").join(of.select(F.col("doc_id").alias("x"), "n").distinct(), "x")
    order = Window.partitionBy("p").orderBy("n", "x")
    near = (F.lag("n").over(order) * threshold.den >= F.col("n") * threshold.num) | (
        F.col("n") * threshold.den >= F.lead("n").over(order) * threshold.num
    )
    kept = sized.select("p", "x", near.alias("near")).where("near").select("p", "x").distinct()
    return small.join(kept, ["p", "x"], "left_semi").unionByName(dealt.where(F.col("rows") > SORTED))


def _open_pairs(told: DataFrame, links: DataFrame, comps: DataFrame, data: DataFrame, of: DataFrame, threshold) -> DataFrame:
    """Pairs within regions that are not connected yet and that the counts leave possible."""
    node = comps.select(F.col("node").alias("_node"), "component")
    linked = links.withColumn("inside", F.lit(True))
    rows = (
        told.join(linked, ["p", "x"], "left")
        .join(node, F.col("x") == F.col("_node"), "left")
        .select("p", "x", F.coalesce("inside", F.lit(False)).alias("inside"), F.col("v1").alias("window"),
                F.coalesce("component", "x").alias("comp"))
    )
    # the pivot stands with those inside; it has met every document, so it isn't compared again
    rows = materialize(rows, "region-rows")
    regions = rows.groupBy("p").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((~F.col("inside")).cast("long")).alias("outside"),
        F.sum((F.col("inside")).cast("long")).alias("within"),
        F.max(~F.col("inside") & F.col("window")).alias("boundary"),
        (F.min("comp") < F.max("comp")).alias("open"),
    )
    regions = materialize(
        regions.where("open AND outside > 0").select(
            "p", "rows", "outside", F.ceil(F.col("outside") / BLOCK).cast("int").alias("blocks"),
            F.when(F.col("boundary"), F.ceil(F.col("within") / BLOCK)).otherwise(0).cast("int").alias("inner"),
        ).where("outside > 1 OR inner > 0").drop("outside"),
        "open-regions",
    )
    # those inside meet nobody but the boundary
    dealt = lookup_join(rows, regions, "p", "rows", ["x"]).where("blocks IS NOT NULL AND (inner > 0 OR NOT inside)")
    dealt = materialize(_met_by_size(dealt, of, threshold), "open-rows")
    anywhere = F.xxhash64("x")
    own = F.pmod(anywhere, F.greatest("blocks", F.lit(1))).cast("int")
    inner = F.pmod(anywhere, F.greatest("inner", F.lit(1))).cast("int")

    def keys(n, made):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), made)).otherwise(F.array().cast("array<struct<i:int,j:int>>"))

    def pair(i, j):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))

    among = keys(F.col("blocks"), lambda k: pair(F.least(own, k), F.greatest(own, k)))
    to_inner = F.when(F.col("window"), keys(F.col("inner"), lambda k: pair(-1 - k, own))).otherwise(
        F.array().cast("array<struct<i:int,j:int>>")
    )
    from_inner = F.when(F.col("inner") > 0, keys(F.col("blocks"), lambda k: pair(-1 - inner, k))).otherwise(
        F.array().cast("array<struct<i:int,j:int>>")
    )
    placed = dealt.select(
        "p", "x", "comp", F.when(F.col("inside"), -1 - inner).otherwise(own).alias("block"),
        F.explode(F.when(F.col("inside"), from_inner).otherwise(F.concat(among, to_inner))).alias("key"),
    )
    counts = by_ids(data, dealt.select(F.col("x").alias("doc_id")).distinct(), "left_semi")
    counts = counts.select(F.col("doc_id").alias("_id"), "data")
    full = placed.join(counts, F.col("x") == F.col("_id")).select("p", "key.i", "key.j", "x", "comp", "block", "data")
    sorted_rows = full.repartition(shuffle_partitions(told.sparkSession), "p", "i", "j").sortWithinPartitions("p", "i", "j")
    return sorted_rows.mapInArrow(partial(_join_blocks, threshold=threshold), "p long, x long").distinct()


# --- the join ---------------------------------------------------------------


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents linked by ``den * |A and B| >= num * |A or B|`` over their sets of word shingles.

    Returns a row per row of ``docs`` (of which only ``doc_id`` and ``text`` are
    read): ``doc_id, n_shingles, component_id``, the smallest ``doc_id`` reachable
    by links, its own included.  Null, empty and white texts have no shingles and no
    links; a text of fewer than ``words`` words has its whole word sequence as one.
    Rows that share an id count as one document that has each of their sets.  Rows
    without an id take part in no link and have no component.  An empty table gives
    no row.
    """
    threshold = Threshold(num, den)
    texts = documents(docs)
    passed = materialize(
        texts.mapInArrow(partial(_sizes, width=words), "doc_id long, n long, sig binary, shingle long, times long"), "sizes"
    )
    sizes = passed.where("sig IS NOT NULL").select("doc_id", "n", "sig")
    known = sizes.where("doc_id IS NOT NULL AND n > 0")
    top = (
        passed.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times"))
        .orderBy(F.desc("times"), "shingle").limit(FREQUENT)
    ).toArrow()
    frequent = top["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent, times = frequent[order], top["times"].to_numpy().astype(np.int64)[order]

    # equal sets: the smallest document stands for all
    equal = known.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    equal = materialize(equal, "equal-sets")
    with_id = texts.where("doc_id IS NOT NULL")
    # read twice below: for the groups and for what is compared
    prefixes = materialize(
        with_id.mapInArrow(
            partial(_prefixes, width=words, threshold=threshold, frequent=frequent, times=times),
            "doc_id long, sig binary, prefix array<long>, counts binary",
        ),
        "prefixes",
    )
    in_group = prefixes.select("doc_id", F.explode("prefix").alias("shingle"))
    # equal sets have equal prefixes, so a pivot is the smallest of its set; other copies go here,
    # where a row has two ids, and not where it has a list
    met = _pivot_pairs(in_group).select("p", F.col("x").alias("doc_id"))
    met = materialize(met, "met-pivots")
    pairs = materialize(
        by_ids(met, equal.select("doc_id"), "left_semi").select("p", F.col("doc_id").alias("x")), "pivot-pairs"
    )

    crowd = materialize(pairs.select(F.col("p").alias("doc_id")).union(pairs.select("x")).distinct(), "crowd")
    data = materialize(  # the first eight bytes of a signature are the size
        by_ids(prefixes.select("doc_id", F.concat(F.substring("sig", 1, 8), "counts").alias("data")), crowd, "left_semi"),
        "class-counts",
    )
    of = materialize(by_ids(known.select("doc_id", "n"), crowd, "left_semi"), "crowd-sizes")
    pairs = materialize(_with_far(pairs, of, threshold), "pair-sizes")
    near, no = pairs.where("NOT far").select("p", "x"), F.lit(False)
    ids = materialize(near.select(F.col("p").alias("doc_id")).union(near.select("x")).distinct(), "near-crowd")
    compared = _star(
        near, by_ids(data, ids, "left_semi"), partial(_counts_compare, threshold=threshold),
        "p long, x long, v0 boolean, v1 boolean",
    )
    told = materialize(
        compared.unionByName(pairs.where("far").select("p", "x", no.alias("v0"), no.alias("v1"))), "pivot-distances"
    )
    links = materialize(
        _verified(texts, told.where("v0").select("p", "x"), words, threshold), "pivot-links"
    )
    comps = components(_links(links, equal, known))
    left = materialize(_open_pairs(told, links, comps, data, of, threshold), "open-pairs")
    if not left.isEmpty():
        more = materialize(_verified(texts, left, words, threshold), "more-links")
        comps = components(_links(links.unionByName(more), equal, known))

    label = equal.join(comps, equal["doc_id"] == comps["node"], "left").select(
        "sig", "rows", F.coalesce("component", "doc_id").alias("_component")
    )
    label = materialize(label, "labels")
    # one set may be that of a large part of all documents
    found = lookup_join(sizes.select("doc_id", F.col("n").alias("n_shingles"), "sig"), label, "sig", "rows", ["doc_id"])
    own = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return found.select(
        "doc_id", "n_shingles", F.when(own, F.col("_component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _pivot_pairs(in_group: DataFrame) -> DataFrame:
    """``(p, x)``: each document with the smallest one of every group it is in."""
    # in order of the ids the first of a group is the smallest; the rows are sent once and met by no other table
    first = Window.partitionBy("shingle").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = in_group.select(F.first("doc_id").over(first).alias("p"), F.col("doc_id").alias("x"))
    return pairs.where("x <> p").distinct()


def _links(links: DataFrame, equal: DataFrame, known: DataFrame) -> DataFrame:
    """Links between documents, and between the rows of an id that has several sets."""
    # a set's smallest document and another id of an equal set are joined through the set itself;
    # an id with several sets joins the documents that stand for them
    several = known.groupBy("doc_id").agg((F.min("sig") < F.max("sig")).alias("several")).where("several").select("doc_id")
    shared = (
        known.join(several, "doc_id", "left_semi")
        .select("sig", F.col("doc_id").alias("u")).distinct()
        .join(equal.select("sig", F.col("doc_id").alias("v")), "sig").select("u", "v")
    )
    return links.select(F.col("p").alias("u"), F.col("x").alias("v")).unionByName(shared)

