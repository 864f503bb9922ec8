"""Phrase collocations, counted over a prefix-free parse of the corpus.

Texts are cut into pieces at punctuation and those into words.  A word whose hash
is divisible by ``trigger`` starts a new chunk, wherever it stands, so equal passages
fall into equal chunks.  A chunk owns the words and ends of pieces up to the next
start and goes on for as many words as a phrase may reach beyond, so neighbours
overlap; a phrase belongs to the chunk that owns its first word and to no other.  The distinct
chunks are the dictionary, with the frequency of each in the parse, and all
counting is done on the dictionary, weighted.

Counts narrow the phrases in three passes: pairs of words by hash; longer phrases,
made of frequent pairs, by hash; then the words themselves of what is left.  Hashes
that fall together only let a phrase through to the last pass, whose counts are
those of the phrases themselves.
"""

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktide.llm.common import materialize, shuffle_partitions

LONGEST = 4
TRIGGER = 24
MOST_OWNED = 256
BLOCK_BYTES = 8 << 20
FILTER_BITS = 27  # 2**27 bits, 16 MB, whatever the corpus; fuller filters only let more phrases through
# A-Z in lower case; . , ; : ! ? and \x0A to \x0D end a piece, tabs are spaces
_TABLE = bytes(
    0x0A if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(text: bytes) -> list[bytes]:
    """Words in a row, with a line feed at the end of each piece."""
    return list(filter(None, text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")))


class _Starts(dict):
    """Whether a word starts a chunk."""

    def __init__(self, trigger):
        super().__init__()
        self.trigger = trigger

    def __missing__(self, word):
        if len(self) > 1 << 18:
            self.clear()
        told = self[word] = word != b"\n" and xxhash.xxh64_intdigest(word) % self.trigger == 0
        return told


# --- the parse --------------------------------------------------------------


def chunks_of(words: list[bytes], longest: int, starts) -> list[tuple[int, bytes]]:
    """``(owned, chunk)`` of a row of words and line feeds: the first ``owned`` of them are in no other chunk.

    Beyond those a chunk goes on for up to ``longest - 1`` words of the piece.
    """
    cuts = np.flatnonzero(np.fromiter(map(starts.__getitem__, words), bool, len(words))).tolist()
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(words)]):
        for c in range(a, b, MOST_OWNED):
            d = min(c + MOST_OWNED, b)
            more = words[d : d + longest - 1]
            if b"\n" in more:
                more = more[: more.index(b"\n")]
            out.append((d - c, b" ".join(words[c:d] + more)))
    return out


def parse(docs: DataFrame, longest: int = LONGEST, trigger: int = TRIGGER) -> DataFrame:
    """The dictionary: ``lang, owned, chunk, n`` of every distinct chunk, with its frequency."""
    lang = F.coalesce(docs["lang"], F.lit("und")).alias("lang") if "lang" in docs.columns else F.lit("und").alias("lang")
    given = docs.select(lang, F.coalesce(docs["text"], F.lit("")).alias("text"))

    def cut(batches):
        starts = _Starts(trigger)
        held: dict = {}
        size = 0

        def flush():
            langs, owned, chunks = zip(*held) if held else ((), (), ())
            return pa.RecordBatch.from_pydict(
                {"lang": pa.array(langs, pa.string()), "owned": pa.array(owned, pa.int32()),
                 "chunk": pa.array(chunks, pa.binary()), "n": pa.array(held.values(), pa.int64())}
            )

        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang").to_pylist()
            for i, lang in enumerate(langs):
                text = texts[i].as_py().encode()
                size += len(text)
                for owned, chunk in chunks_of(_words(text), longest, starts):
                    key = lang, owned, chunk
                    held[key] = held.get(key, 0) + 1
                if size > BLOCK_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    partial = given.mapInArrow(cut, "lang string, owned int, chunk binary, n long")
    return materialize(partial.groupBy("lang", "owned", "chunk").agg(F.sum("n").alias("n")), "parse")


class Block:
    """Chunks of one language as arrays: word ids, and for every place its chunk's weight and the words that follow."""

    def __init__(self, lang: str, rows: list[tuple[int, bytes, int]]):
        owned, chunks, weights = zip(*rows)
        self.words = b" \n ".join(chunks).split(b" ")
        local: dict[bytes, int] = defaultdict(count().__next__)
        end = local[b"\n"]
        self.ids = np.fromiter(map(local.__getitem__, self.words), np.int64, len(self.words))
        self.vocabulary = list(local)
        self.inner = self.ids != end
        sizes = np.fromiter((c.count(b" ") for c in chunks), np.int64, len(chunks)) + 2  # with the line feed after it
        begins = np.cumsum(sizes) - sizes
        place = np.arange(len(self.ids))
        chunk = np.repeat(np.arange(len(chunks)), sizes)[: len(self.ids)]
        self.weights = np.array(weights, np.int64)[chunk]
        ends = np.append(np.flatnonzero(~self.inner), len(self.ids))
        after = ends[np.searchsorted(ends, place)]
        # phrases that start here may have this many words; 0 for words another chunk owns
        self.room = np.where(place - begins[chunk] < np.array(owned)[chunk], after - place, 0)
        self.lang = lang
        seed = xxhash.xxh64_intdigest(lang.encode()) & (2**63 - 1)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary), np.uint64, len(local))

    def key(self, at: np.ndarray, size: int) -> np.ndarray:
        """A 64-bit hash of the phrases of ``size`` words at some places."""
        told = self.hashes[self.ids[at]]
        for step in range(1, size):
            told = (told ^ (told >> np.uint64(29))) * _MIX + self.hashes[self.ids[at + step]]
        told = (told ^ (told >> np.uint64(32))) * _MIX
        return told ^ (told >> np.uint64(29))

    def at(self, size: int) -> np.ndarray:
        return np.flatnonzero(self.room >= size)


def _blocks(batches):
    """The dictionary rows of a task, some megabytes of one language at a time."""
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for lang, owned, chunk, n in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(lang, []).append((owned, chunk, n))
            size += len(chunk)
            if size > BLOCK_BYTES:
                for told, rows in held.items():
                    yield Block(told, rows)
                held, size = {}, 0
    for told, rows in held.items():
        yield Block(told, rows)


def _summed(keys: np.ndarray, weights: np.ndarray):
    """Distinct keys, the sums of their weights and a place of each."""
    order = np.argsort(keys)
    told = keys[order]
    first = np.flatnonzero(np.append(True, told[1:] != told[:-1])) if len(told) else np.empty(0, np.int64)
    sums = np.add.reduceat(weights[order], first) if len(told) else weights
    return told[first], sums, order[first]


# --- filters ----------------------------------------------------------------


def frequent_filter(counted: DataFrame, least: int, bits: int) -> bytes:
    """A bit per value of the first ``bits`` of a key, set where a key was counted ``least`` times or more.

    Blocks of the filter are made by tasks; the whole has a fixed size.
    """
    slot = F.shiftrightunsigned("key", 64 - bits)
    block = 1 << min(16, bits)
    frequent = counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    slots = frequent.select(F.floor(slot / block).alias("block"), (slot % block).cast("int").alias("bit"))
    bitmap = slots.repartition(shuffle_partitions(counted.sparkSession), "block").sortWithinPartitions("block")

    def fill(batches):
        held, bits_of = None, None
        for batch in batches:
            numbers, places = batch.column("block").to_numpy(), batch.column("bit").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for some, of in zip(np.split(numbers, cuts), np.split(places, cuts)):
                if len(some) and some[0] != held:
                    if held is not None:
                        yield pa.RecordBatch.from_pydict({"block": [int(held)], "bitmap": pa.array([np.packbits(bits_of).tobytes()], pa.binary())})
                    held, bits_of = some[0], np.zeros(block, np.uint8)
                if len(some):
                    bits_of[of] = 1
        if held is not None:
            yield pa.RecordBatch.from_pydict({"block": [int(held)], "bitmap": pa.array([np.packbits(bits_of).tobytes()], pa.binary())})

    whole = bytearray(max(1, (1 << bits) // 8))
    size = max(1, block // 8)
    for row in bitmap.mapInArrow(fill, "block long, bitmap binary").toLocalIterator():
        whole[row["block"] * size : (row["block"] + 1) * size] = row["bitmap"]
    return bytes(whole)


def _passed(whole: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (whole[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0


# --- counting ---------------------------------------------------------------


def _pair_flags(block: Block, pairs: np.ndarray, bits: int) -> np.ndarray:
    """For every place whether the two words from it are a frequent pair, as far as the filter tells.

    The second word may lie in the overlap, so pairs are looked up wherever two words follow each other.
    """
    good = np.zeros(len(block.ids), bool)
    at = np.flatnonzero(block.inner[:-1] & block.inner[1:])
    good[at] = _passed(pairs, block.key(at, 2), bits)
    return good


def _long_places(block: Block, flags: np.ndarray, size: int) -> np.ndarray:
    at = block.at(size)
    for step in range(size - 1):
        at = at[flags[at + step]]
    return at


def count_phrases(parsed: DataFrame, least: int, longest: int = LONGEST, bits: int = FILTER_BITS) -> DataFrame:
    """``lang, size, phrase, f``: every word, and every phrase of 2 to ``longest`` words that occurs ``least`` times."""
    spark = parsed.sparkSession
    rows = parsed.select("lang", "owned", "chunk", "n")

    def pairs(batches):
        for block in _blocks(batches):
            at = block.at(2)
            keys, sums, _ = _summed(block.key(at, 2), block.weights[at])
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "n": pa.array(sums)})

    sent_pairs = spark.sparkContext.broadcast(
        frequent_filter(rows.mapInArrow(pairs, "key long, n long"), least, bits)
    )

    def longer(batches):
        told = np.frombuffer(sent_pairs.value, np.uint8)
        for block in _blocks(batches):
            flags = _pair_flags(block, told, bits)
            for size in range(3, longest + 1):
                at = _long_places(block, flags, size)
                keys, sums, _ = _summed(block.key(at, size), block.weights[at])
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "n": pa.array(sums)})

    sent_longer = spark.sparkContext.broadcast(
        frequent_filter(rows.mapInArrow(longer, "key long, n long"), least, bits)
    )

    def exact(batches):
        told, far = np.frombuffer(sent_pairs.value, np.uint8), np.frombuffer(sent_longer.value, np.uint8)
        for block in _blocks(batches):
            flags = _pair_flags(block, told, bits)
            # numbers of the distinct frequent pairs, so that longer phrases are told apart by two numbers
            at = np.flatnonzero(flags)
            number = np.zeros(len(block.ids), np.int64)
            number[at] = np.unique(block.ids[at] << 32 | block.ids[at + 1], return_inverse=True)[1]
            for size in range(1, longest + 1):
                at = block.at(1) if size == 1 else _long_places(block, flags, size)
                if size <= 2:
                    keys = block.ids[at] if size == 1 else number[at]
                else:
                    at = at[_passed(far, block.key(at, size), bits)]
                    keys = number[at]
                    for step in range(1, size - 1):  # one more word each
                        keys = np.unique(keys, return_inverse=True)[1] << 32 | number[at + step]
                _, sums, first = _summed(keys, block.weights[at])
                phrases = [b" ".join(block.words[i : i + size]) for i in at[first].tolist()]
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([block.lang] * len(phrases), pa.string()), "size": pa.array([size] * len(phrases), pa.int32()),
                     "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "f": pa.array(sums)}
                )

    found = rows.mapInArrow(exact, "lang string, size int, phrase string, f long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("size") == 1) | (F.col("f") >= least))


def collocations(
    docs: DataFrame, least: int = 30, longest: int = LONGEST, top: int = 2000, inside_percent: int = 80,
    trigger: int = TRIGGER, bits: int = FILTER_BITS,
) -> DataFrame:
    """The best scored phrases of 2 to ``longest`` words of each language.

    ``docs`` needs ``text`` and ``lang`` (null, or no such column: ``und``); other
    columns are not read.  Letters A-Z count as lower case; phrases do not cross
    ``.,;:!?`` or line ends.  A phrase that occurs ``a`` times, at least ``least``,
    scores floor(2000000 a / (l + r)) at its lowest-scoring cut into a first part that
    occurs ``l`` times and a rest that occurs ``r`` times (ties: the shortest first
    part).  Phrases within a longer one that occurs in ``inside_percent`` of their
    occurrences are dropped.  Null and empty texts have no words; repeated rows count
    as often as they come; texts may be of any length.  An empty table gives no row.

    Returns ``lang, rank, phrase, a, l, r, n, score``, ``top`` a language by score and
    ``a`` descending, then the phrase; ``n`` counts all words of the language.
    """
    parsed = parse(docs, longest, trigger)
    counts = materialize(count_phrases(parsed, least, longest, bits), "phrase-counts")
    totals = counts.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    words = F.split("phrase", " ")

    def part(start, n):
        return F.array_join(F.slice(words, start, n), " ")

    candidates = counts.where("size > 1").withColumnRenamed("f", "a")
    cuts = candidates.select(
        "lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select("*", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = counts.select("lang", "phrase", "f")
    for name, side in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(of.select("lang", F.col("phrase").alias(name), F.col("f").alias(side)), ["lang", name])
    wide = [F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r")]
    cuts = cuts.select("*", (wide[0] * F.lit(2_000_000)).alias("_a"), (wide[1] + wide[2]).alias("_lr"))
    cuts = cuts.withColumn("score", F.expr("_a div _lr"))  # whole numbers of any size
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")),
        )
    )
    inside = (
        candidates.where("size > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * inside_percent)
    )
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = (
        kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    )
    # languages are as many as the corpus names; the join is one row each
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
rows AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM rows GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM rows, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)
  GROUP BY ALL HAVING size = 1 OR count(*) >= 30),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * c.a // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT lang, phrase, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS cut FROM cuts GROUP BY lang, phrase, a),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM candidates WHERE size > 2)))
  GROUP BY lang, phrase),
ranked AS (
  SELECT lang, phrase, a, cut, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, cut.l AS l, cut.r AS r, n, cut.score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
