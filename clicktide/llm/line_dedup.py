"""Repeated lines, found by ranges of line hashes; only bitmaps of kept lines travel.

A line's key is the line without white space at its ends and with A-Z in lower
case.  A key of at least ``least_chars`` characters belongs to the smallest
document that holds it; all its lines in other documents go.  Lines are hashed to
128 bits and sorted by hash, document and position within ranges of the hash;
the first of each hash is its owner.  The few hashes that own more than a 1024th
of all lines would weigh on one range; their owner is known from the count that
finds them, so they are marked where they lie.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktide.llm.common import ascii_lower, documents, materialize, shuffle_partitions

WHITE = " \t\n\x0b\f\r"
HOT_SHARE = 1024  # at most this many hashes are hot


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _rows(docs: DataFrame, others: bool = False) -> DataFrame:
    # rows that share an id are told apart by their text
    return documents(docs, others).withColumn("_text_hash", F.xxhash64("text"))


def hashed_lines(docs: DataFrame, least_chars: int = 10) -> DataFrame:
    """``doc_id, _text_hash, pos, h1, h2`` of every line whose key is long enough."""
    lines = _rows(docs).select("doc_id", "_text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "_text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= least_chars).select(
        "doc_id", "_text_hash", "pos", F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("second"), "key").alias("h2"),
    )


def dropped_lines(lines: DataFrame) -> DataFrame:
    """Lines whose hash a smaller document holds: ``doc_id, _text_hash, pos``."""
    hashes = ["h1", "h2"]
    share = F.ceil(F.lit(lines.count()) / HOT_SHARE)
    hot = materialize(
        lines.groupBy(*hashes)
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner"))
        .where(F.col("n") >= share)
        .select(*hashes, "owner"),
        "hot-lines",
    )
    here = lines.join(F.broadcast(hot), hashes)
    ranged = lines.join(F.broadcast(hot), hashes, "left_anti").repartitionByRange(
        shuffle_partitions(lines.sparkSession), *hashes
    )
    stream = (
        Window.partitionBy(*hashes)
        .orderBy(F.asc_nulls_last("doc_id"), "_text_hash", "pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    there = ranged.withColumn("owner", F.first("doc_id").over(stream))
    columns = ["doc_id", "_text_hash", "pos", "owner"]
    return (
        here.select(*columns)
        .unionByName(there.select(*columns))
        .where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        .drop("owner")
    )


def keep_bitmaps(docs: DataFrame, least_chars: int = 10) -> DataFrame:
    """Compressed bitmaps of kept lines, for the documents that lose any.

    ``doc_id, _text_hash, n_dropped, keep``: ``keep`` lists the 64-line words that
    are not all ones, as ``(word, bits)`` in order; bit ``i`` of word ``w`` is set
    if line ``64 w + i`` stays.
    """
    lines = materialize(hashed_lines(docs, least_chars), "line-hashes")
    word = F.expr("pos div 64").cast("int")
    bit = F.expr("shiftleft(1L, pos % 64)")
    return (
        dropped_lines(lines)
        .repartition("doc_id", "_text_hash")
        .groupBy("doc_id", "_text_hash", word.alias("word"))
        .agg(F.bit_or(bit).alias("gone"))
        .groupBy("doc_id", "_text_hash")
        .agg(
            F.sum(F.bit_count("gone")).alias("n_dropped"),
            F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
        )
    )


def _dense(keep: Column) -> Column:
    """The words of a bitmap by number, up to the last that has a zero."""
    by_word = F.map_from_entries(keep)
    return F.transform(
        F.sequence(F.lit(0), F.element_at(keep, -1)["word"]),
        lambda w: F.coalesce(F.element_at(by_word, w), F.lit(-1).cast("long")),
    )


def dedup_lines(docs: DataFrame, least_chars: int = 10, others: bool = False) -> DataFrame:
    """Remove lines whose key a smaller document holds.

    Returns a row per row of ``docs`` (of which only ``doc_id`` and ``text`` are
    read): ``doc_id, n_lines`` before dropping, ``n_dropped`` and ``kept``, the
    other lines joined by line ends.  A null or empty text is one empty line.  All
    lines may go; ``kept`` is empty then.  Within its owner a key keeps all its
    lines.  Rows that share an id are one document as to owning; rows without an
    id are one document that comes last.  An empty table gives no row.  With
    ``others`` the remaining columns come along in a struct.
    """
    rows = _rows(docs, others)
    # the words are laid out on this side of the shuffle, once per document
    bitmaps = keep_bitmaps(docs, least_chars).select(
        F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_hash"), "n_dropped", _dense(F.col("keep")).alias("_words")
    )
    same = rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["_text_hash"] == F.col("_hash"))
    kept = F.filter(
        F.split("text", "\n"),
        lambda line, i: F.coalesce(F.getbit(F.get("_words", F.floor(i / 64).cast("int")), i % 64), F.lit(1)) == 1,
    )
    return rows.join(bitmaps, same, "left").select(
        "doc_id",
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_id").isNull() & F.col("_words").isNull(), F.col("text"))
        .otherwise(F.array_join(kept, "\n"))
        .alias("kept"),
        *(["others"] if others else []),
    )


ORACLE = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM rows
),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
    SELECT k.doc_id, k.pos, k.line, coalesce(o.owner <> k.doc_id, false) AS dropped
    FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
