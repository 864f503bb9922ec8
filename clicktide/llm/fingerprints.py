"""Document fingerprints that can be added and subtracted.

A text falls into pieces, its paragraphs (long ones at sentence ends).  Every
piece is hashed to a wide vector, and the fingerprint is the sum of the vectors,
each lane modulo a power of two.  The order of the pieces doesn't matter, equal
multisets have equal sums, and a piece is inserted or deleted by adding or
subtracting its vector.

A vector has 25 lanes of 60 bits:

* 1 lane that counts pieces, modulo 2**60;
* 4 lanes of a 60-bit hash, modulo 2**60, which tell different multisets apart;
* 20 lanes of three 20-bit fields, modulo 2**20 each.  A field is 1 for half of
  all pieces, by their hash.  Read as plus or minus one, the squared difference
  of two sums is on average the number of pieces in which the texts differ, so the
  60 fields estimate the likeness of two fingerprints without their texts.

Everything here is a column expression.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktide.llm.common import documents, materialize, shuffle_partitions

HASH_LANES = 4
FIELD_LANES = 20
LANES = 1 + HASH_LANES + FIELD_LANES
_BITS60 = (1 << 60) - 1
_ONES = 1 | 1 << 20 | 1 << 40  # lowest bit of each field
_TOPS = _ONES << 19
_LOWS = _BITS60 ^ _TOPS
# after a line end, or after a sentence end and a space; no character is lost
PIECE_ENDS = r"(?<=\n)|(?<=[.!?] )"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _and(a: Column, value: int) -> Column:
    return a.bitwiseAND(_long(value))


# --- vectors ----------------------------------------------------------------


def _add_fields(a: Column, b: Column) -> Column:
    """Field by field, without a carry from one to the next."""
    return (_and(a, _LOWS) + _and(b, _LOWS)).bitwiseXOR(_and(a.bitwiseXOR(b), _TOPS))


def _add_plain(a: Column, b: Column) -> Column:
    return _and(a + b, _BITS60)


def _by_lane(lanes_a, lanes_b, plain, fields) -> Column:
    split = 1 + HASH_LANES
    return F.array(
        *[(plain if i < split else fields)(lanes_a(i), lanes_b(i)) for i in range(LANES)]
    )


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' pieces together."""
    return _by_lane(lambda i: F.get(a, i), lambda i: F.get(b, i), _add_plain, _add_fields)


def _negative_fields(a: Column) -> Column:
    return _add_fields(_and(F.bitwise_not(a), _BITS60), _long(_ONES))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of what is left of ``a`` when the pieces of ``b`` are deleted."""
    return _by_lane(
        lambda i: F.get(a, i), lambda i: F.get(b, i),
        lambda x, y: _and(x + (_long(_BITS60) - y) + _long(1), _BITS60),
        lambda x, y: _add_fields(x, _negative_fields(y)),
    )


def pieces(text: Column) -> Column:
    return F.filter(F.split(text, PIECE_ENDS), lambda piece: piece != "")


def vector(text: Column) -> Column:
    """The fingerprint of a text as an array of lanes; all zero for a null or empty text."""
    hashed = F.transform(
        pieces(F.coalesce(text, F.lit(""))),
        lambda p: F.struct(
            *[_and(F.xxhash64(F.lit(f"lane {k}"), p), _BITS60).alias(f"h{k}") for k in range(HASH_LANES)],
            F.xxhash64(F.lit("fields"), p).alias("f"),
        ),
    )

    def lane(h, i):
        if i == 0:
            return _long(1)
        if i <= HASH_LANES:
            return h[f"h{i - 1}"]
        return _and(F.shiftrightunsigned(h["f"], i - 1 - HASH_LANES), _ONES)

    return F.aggregate(
        hashed,
        F.array(*[_long(0)] * LANES),
        lambda total, h: _by_lane(lambda i: F.get(total, i), lambda i: lane(h, i), _add_plain, _add_fields),
    )


def spelled(lanes: Column) -> Column:
    """A vector as text: 15 hexadecimal digits a lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share, 0 to 1, of pieces that two vectors have in common; 1 for equal vectors.

    Off by about 0.18 times the share of pieces that differ.
    """
    size = (F.get(a, 0) + F.get(b, 0)).cast("double")
    gap = (F.get(a, 0) - F.get(b, 0)).cast("double")

    def field(lane, k):
        return _and(F.shiftrightunsigned(lane, 20 * k), (1 << 20) - 1)

    def squares(x, y):
        terms = []
        for k in range(3):
            apart = _and(field(x, k) - field(y, k) + _long(3 << 19), (1 << 20) - 1) - _long(1 << 19)
            terms.append((gap - 2 * apart) * (gap - 2 * apart))
        return reduce(lambda s, t: s + t, terms)

    first = 2 + HASH_LANES
    both = F.arrays_zip(
        F.slice(a, first, FIELD_LANES).alias("x"), F.slice(b, first, FIELD_LANES).alias("y")
    )
    total = F.aggregate(both, F.lit(0.0), lambda s, z: s + squares(z["x"], z["y"]))
    near = 1 - total / (3.0 * FIELD_LANES) / F.greatest(size, F.lit(1.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` for every row; other columns than ``doc_id`` and ``text`` are not read."""
    return documents(docs).select("doc_id", spelled(vector(F.col("text"))).alias("fingerprint"))


# --- comparison with an edit ------------------------------------------------


def neighbours(keys: DataFrame) -> DataFrame:
    """``keys`` (``doc_id, hash, n_chars``, distinct) with the key and size of the row before, around the end.

    Rows are ordered by ``doc_id`` (none first), then ``hash``, over ranges; only the
    first key of each range is compared across ranges.
    """
    ranged = materialize(
        keys.repartitionByRange(shuffle_partitions(keys.sparkSession), "doc_id", "hash").withColumn(
            "range", F.spark_partition_id()
        ),
        "key-ranges",
    )
    ends = ranged.groupBy("range").agg(
        F.max(F.struct("doc_id", "hash", "n_chars")).alias("last")
    )
    # one row per range
    over = Window.orderBy("range")
    everything = Window.partitionBy()
    ends = ends.select(
        "range",
        F.coalesce(F.lag("last").over(over), F.max(F.struct("range", "last")).over(everything)["last"]).alias("before"),
    )
    inside = Window.partitionBy("range").orderBy("doc_id", "hash")
    told = ranged.join(F.broadcast(ends), "range").withColumn(
        "previous", F.coalesce(F.lag(F.struct("doc_id", "hash", "n_chars")).over(inside), F.col("before"))
    )
    return told.select(
        "doc_id", "hash", F.col("previous.doc_id").alias("previous_id"), F.col("previous.hash").alias("previous_hash"), F.col("previous.n_chars").alias("previous_chars"),
    )


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of an edit of it, and how alike they are.

    In the edit the last half (rounded down) of the characters is replaced by as
    many, or all, first ones of the next document in ascending ``doc_id``; the
    first document follows the last.  Rows without an id come first; rows that
    share an id are ordered by the hash of their text, and rows equal in both
    count as one in that order.  A single document follows itself.  A null text
    counts as empty.  An empty table gives no row.

    Returns ``doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited, near_next``.
    """
    texts = documents(docs)
    rows = texts.select("doc_id", F.xxhash64("text").alias("hash"), "text", vector(F.col("text")).alias("lanes"))
    keys = texts.select("doc_id", F.xxhash64("text").alias("hash"), F.length("text").alias("n_chars")).distinct()
    order = neighbours(keys)

    # each document sends the row before it what that row needs
    own = rows.alias("d").join(
        order.alias("o"),
        F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.hash") == F.col("o.hash")),
    )
    sent = own.select(
        "previous_id", "previous_hash",
        F.struct(
            F.expr("left(d.text, o.previous_chars div 2)").alias("start"), F.col("d.lanes").alias("lanes")
        ).alias("next"),
    )
    sent = sent.groupBy("previous_id", "previous_hash").agg(F.min("next").alias("next"))  # equal rows
    edited = rows.join(
        sent, rows["doc_id"].eqNullSafe(sent["previous_id"]) & (rows["hash"] == sent["previous_hash"])
    ).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "lanes", F.col("next.lanes").alias("next_lanes"),
        F.expr("left(text, length(text) - length(text) div 2) || next.start").alias("edited"),
    )
    # a generated row keeps the edit's vector from being worked out once per use
    once = edited.select(
        "doc_id", "n_chars", "lanes", "next_lanes",
        F.inline(F.array(F.struct("edited", vector(F.col("edited")).alias("edited_lanes")))),
    )
    return once.select(
        "doc_id", "n_chars", "edited", spelled(F.col("lanes")).alias("fingerprint"),
        spelled(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
