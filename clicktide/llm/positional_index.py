"""A distributed positional inverted index, and benchmark passages found with it.

Tasks write the index as segments, each over some documents: the words of all
its documents lie in one numbering, and every term has the sorted list of its
places.  A segment is one row, so any task can search it alone and a lost one is
searched again.

A phrase is looked up from its rarest term on: each place of that term, less its
offset in the phrase, is a possible start; the lists of the next rarer terms,
adjusted by their offsets, are intersected with the starts until all terms have
been met.  Phrases are looked up all together, in blocks of bounded size.
"""

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import documents, materialize, new_path

SEGMENT_WORDS = 1 << 21
PHRASE_BLOCK = 200_000  # phrases sent to all tasks at a time, at most
MOST_TERMS = 2_000_000  # terms sent to all tasks to index those alone; with more, all terms are indexed
STARTS_AT_ONCE = 1 << 21
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Everything below 0x80 that is neither a digit nor a letter separates words.
_SPACED = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in (_LOWER[b] for b in range(256))
)
_SEGMENT = "segment long, doc_ids binary, known binary, ends binary, terms array<binary>, starts binary, places binary"


def words_of(text: str) -> list[bytes]:
    """The words of a text: runs of digits, of letters A-Z in lower case and of all characters beyond ASCII."""
    return text.encode().translate(_SPACED).split()


# --- the index --------------------------------------------------------------


def build_index(docs: DataFrame, terms: list[bytes] | None = None, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Write the segments of an index of ``doc_id`` and ``text`` and return their table.

    With ``terms`` only their places are kept; the numbering counts all words.  A
    null or empty text has no word.  Rows without an id and repeated rows are
    documents of their own.  Extra columns are not read.  A text of any length
    lies in one segment, which ends after the document that brings it to
    ``segment_words``.  An empty table has no segment.
    """
    spark = docs.sparkSession
    kept = spark.sparkContext.broadcast(None if terms is None else {t: i for i, t in enumerate(terms)})
    built = documents(docs).mapInArrow(partial(_write_segments, kept=kept, segment_words=segment_words), _SEGMENT)
    path = new_path(spark, "positional-index")
    built.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(built.schema).parquet(path)


def _write_segments(batches, kept, segment_words):
    given = kept.value
    part, seq, doc_ids, ends, ids = TaskContext.get().partitionId(), 0, [], [], []
    local: dict = {}

    def flush():
        every = np.concatenate(ids) if ids else np.empty(0, np.int64)
        at = np.flatnonzero(every >= 0)
        order = at[np.argsort(every[at], kind="stable")]
        found, starts = np.unique(every[order], return_index=True)
        names = list(local) if given is None else list(given)
        row = {
            "segment": [part << 32 | seq],
            "doc_ids": [np.array([d or 0 for d in doc_ids], "<i8").tobytes()],
            "known": [bytes(d is not None for d in doc_ids)],
            "ends": [np.cumsum(ends).astype("<i8").tobytes()],
            "terms": pa.array([[names[i] for i in found]], pa.list_(pa.binary())),
            "starts": [np.append(starts, len(order)).astype("<i8").tobytes()],
            "places": [order.astype("<u4").tobytes()],
        }
        return pa.RecordBatch.from_pydict(row)

    held = 0
    for batch in batches:
        texts = batch.column("text")
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            words = words_of(texts[i].as_py())
            if given is None:
                codes = (local.setdefault(w, len(local)) for w in words)
            else:
                codes = map(given.get, words, repeat(-1))
            ids.append(np.fromiter(codes, np.int64, len(words)))
            doc_ids.append(doc_id)
            ends.append(len(words))
            held += len(words)
            if held >= segment_words:
                yield flush()
                seq, doc_ids, ends, ids, held, local = seq + 1, [], [], [], 0, {}
    if doc_ids:
        yield flush()


class Segment:
    """A segment in memory: documents, terms and their places."""

    def __init__(self, row: dict):
        self.number = row["segment"]
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.terms = {t: i for i, t in enumerate(row["terms"])}
        self.starts = np.frombuffer(row["starts"], "<i8")
        self.counts = np.append(np.diff(self.starts), 0)  # the last one is that of terms not there
        self.places = np.frombuffer(row["places"], "<u4").astype(np.int64)
        # one sorted list of (term, place) serves all intersections
        self.keys = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)) << 32 | self.places

    def codes(self, terms) -> np.ndarray:
        return np.fromiter(map(self.terms.get, terms, repeat(len(self.terms))), np.int64, len(terms))

    def has(self, codes, places) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(codes), bool)
        wanted = codes << 32 | places
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[at] == wanted) & (places >= 0)

    def document(self, places) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


# --- phrases ----------------------------------------------------------------


class Phrases:
    """Distinct phrases as term numbers, with -1 after their end."""

    def __init__(self, phrases: list[tuple[bytes, ...]]):
        self.terms = list(dict.fromkeys(t for p in phrases for t in p))
        number = {t: i for i, t in enumerate(self.terms)}
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.codes = np.full((len(phrases), int(self.lengths.max(initial=1))), -1, np.int64)
        for row, p in zip(self.codes, phrases):
            row[: len(p)] = [number[t] for t in p]


def find_phrases(segment: Segment, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """``(phrase, start)`` of every occurrence that lies within one document."""
    none = len(segment.terms)
    codes = np.append(segment.codes(phrases.terms), none)[phrases.codes]
    used = phrases.codes >= 0
    counts = np.where(used, segment.counts[codes], np.iinfo(np.int64).max)
    order = np.argsort(counts, axis=1, kind="stable")  # rarest first, unused places last
    rarest = counts.min(axis=1)
    found = []
    alive = np.flatnonzero((rarest > 0) & (phrases.lengths > 0))
    upto = np.cumsum(rarest[alive])
    for at in range(0, int(upto[-1]) if len(upto) else 0, STARTS_AT_ONCE):
        # places of the rarest terms, some at a time, whichever phrases they belong to
        stop = min(at + STARTS_AT_ONCE, int(upto[-1]))
        wanted = np.arange(at, stop)
        turn = np.searchsorted(upto, wanted, side="right")
        phrase = alive[turn]
        first = order[phrase, 0]
        place = segment.places[segment.starts[codes[phrase, first]] + wanted - (upto[turn] - rarest[phrase])]
        start = place - first
        for step in range(1, order.shape[1]):
            offset = order[phrase, step]
            more = used[phrase, offset]
            good = ~more
            good[more] = segment.has(codes[phrase[more], offset[more]], start[more] + offset[more])
            phrase, start = phrase[good], start[good]
        # a phrase of one term has not been looked at before its start, and may not cross documents
        inside = (start >= 0) & (segment.document(start) == segment.document(start + phrases.lengths[phrase] - 1))
        found.append((phrase[inside], start[inside]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def phrase_matches(index: DataFrame, phrases: list[tuple[bytes, ...]]) -> DataFrame:
    """``segment, ordinal, phrase, start``: every occurrence of every phrase, by its number in the list.

    ``ordinal`` numbers the documents of a segment, ``start`` the words of the
    document.  A phrase without words occurs nowhere.
    """
    sent = index.sparkSession.sparkContext.broadcast(Phrases(phrases))

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                phrase, start = find_phrases(segment, sent.value)
                doc = segment.document(start)
                columns = {"segment": np.full(len(doc), segment.number), "ordinal": doc, "phrase": phrase, "start": start - segment.begins[doc]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    return index.mapInArrow(search, "segment long, ordinal long, phrase long, start long")


# --- proximity --------------------------------------------------------------


def near_spans(segment: Segment, terms: tuple[bytes, ...], within: int) -> list[tuple[int, int]]:
    """``(first, last)`` word of the shortest spans of one document that hold all terms, of at most ``within`` words.

    A span is shortest if no other one lies inside it.
    """
    codes = segment.codes(list(dict.fromkeys(terms)))
    if not len(codes) or (segment.counts[codes] == 0).any():
        return []
    codes = codes[np.argsort(segment.counts[codes], kind="stable")]
    lists = [segment.places[segment.starts[c] : segment.starts[c + 1]] for c in codes]
    anchors = lists[0]
    for places in lists[1:]:  # anchors that have each term near enough
        low = np.searchsorted(places, anchors - within + 1)
        anchors = anchors[(low < len(places)) & (places[np.minimum(low, len(places) - 1)] < anchors + within)]
    near = []
    for k, places in enumerate(lists):
        at = np.searchsorted(anchors, places - within + 1)
        kept = places[(at < len(anchors)) & (anchors[np.minimum(at, max(len(anchors) - 1, 0))] < places + within)] if len(anchors) else places[:0]
        near += [(int(p), k) for p in kept]
    near.sort()
    doc = segment.document(np.array([p for p, _ in near], np.int64))
    spans, last, held = [], {}, -1
    for i, (place, k) in enumerate(near):
        if doc[i] != held:
            last, held = {}, doc[i]
        last[k] = place
        if len(last) == len(lists):
            first = min(last.values())
            if place - first < within and (not spans or spans[-1][0] < first):
                spans.append((first, place))
    return spans


def proximity_matches(index: DataFrame, groups: list[tuple[bytes, ...]], within: int) -> DataFrame:
    """``segment, ordinal, group, first, last``: spans of at most ``within`` words that hold all terms of a group.

    Groups are numbered as in the list; words of a document from 0.
    """
    sent = index.sparkSession.sparkContext.broadcast(groups)

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                for number, terms in enumerate(sent.value):
                    spans = np.array(near_spans(segment, terms, within), np.int64).reshape(-1, 2)
                    doc = segment.document(spans[:, 0])
                    columns = (np.full(len(doc), segment.number), doc, np.full(len(doc), number), spans[:, 0] - segment.begins[doc], spans[:, 1] - segment.begins[doc])
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(("segment", "ordinal", "group", "first", "last"), columns)})

    return index.mapInArrow(search, "segment long, ordinal long, group long, first long, last long")


def indexed_documents(index: DataFrame) -> DataFrame:
    """``segment, ordinal, doc_id, n_words`` of every document of an index."""

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["ends"], "<i8")
                known = np.frombuffer(row["known"], np.uint8)
                yield pa.RecordBatch.from_pydict(
                    {"segment": pa.array(np.full(len(ends), row["segment"]), pa.int64()), "ordinal": pa.array(np.arange(len(ends)), pa.int64()),
                     "doc_id": pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=known == 0), "n_words": pa.array(np.diff(ends, prepend=0), pa.int64())}
                )

    return index.select("segment", "doc_ids", "known", "ends").mapInArrow(
        rows, "segment long, ordinal long, doc_id long, n_words long"
    )


# --- benchmark passages -----------------------------------------------------


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; a shorter text that has words is one window."""
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def _item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """``words, items``: every distinct window with the items that have it."""

    def cut(batches):
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                made = [b" ".join(w).decode() for w in dict.fromkeys(windows_of(words_of(text), size))]
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(made), pa.string()), "words": pa.array(made, pa.string())})

    given = benchmark.select(benchmark["item_id"].cast("string").alias("item"), F.coalesce(benchmark["text"], F.lit("")).alias("text"))
    cuts = given.mapInArrow(cut, "item string, words string")
    return cuts.groupBy("words").agg(F.collect_set("item").alias("items"))


def _hits(index: DataFrame, block: list[tuple[str, list[str]]]) -> DataFrame:
    """``segment, ordinal, first, stop, item``: runs of hit words by item, for one block of windows."""
    phrases = Phrases([tuple(w.encode().split(b" ")) for w, _ in block])
    names = list(dict.fromkeys(i for _, items in block for i in items or [None]))
    number = {name: i for i, name in enumerate(names)}
    of_window = [[number[i] for i in items or [None]] for _, items in block]
    sent = index.sparkSession.sparkContext.broadcast((phrases, names, of_window))

    def search(batches):
        phrases, names, of_window = sent.value
        sizes = np.array([len(x) for x in of_window], np.int64)
        flat, begin = np.array([i for x in of_window for i in x], np.int64), np.cumsum(sizes) - sizes
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                phrase, start = find_phrases(segment, phrases)
                each = np.repeat(np.arange(len(phrase)), sizes[phrase])
                item = flat[begin[phrase[each]] + np.arange(len(each)) - np.repeat(np.cumsum(sizes[phrase]) - sizes[phrase], sizes[phrase])]
                first, stop = start[each], start[each] + phrases.lengths[phrase[each]]
                order = np.lexsort((first, item))
                item, first, stop = item[order], first[order], stop[order]
                doc = segment.document(first)
                # windows of one item that touch become one run
                new = np.ones(len(item), bool)
                if len(item):
                    same = (item[1:] == item[:-1]) & (doc[1:] == doc[:-1])
                    new[1:] = ~same | (first[1:] > stop[:-1])
                group = np.flatnonzero(new)
                last = np.maximum.reduceat(stop, group) if len(group) else stop
                told = {"segment": np.full(len(group), segment.number), "ordinal": doc[group], "first": first[group], "stop": last}
                yield pa.RecordBatch.from_pydict(
                    {**{k: pa.array(v, pa.int64()) for k, v in told.items()}, "item": pa.array([names[i] for i in item[group]], pa.string())}
                )

    return index.mapInArrow(search, "segment long, ordinal long, first long, stop long, item string")


def covered(runs: Column) -> Column:
    """The number of words in any of some ``(first, stop)`` runs."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto"))

    def add(told, run):
        more = F.greatest(run["stop"] - F.greatest(run["first"], told["upto"]), F.lit(0).cast("long"))
        return F.struct((told["n"] + more).alias("n"), F.greatest(told["upto"], run["stop"]).alias("upto"))

    return F.aggregate(F.sort_array(runs), empty, add)["n"]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, block: int = PHRASE_BLOCK) -> DataFrame:
    """Where documents hold windows of ``size`` consecutive words of benchmark items.

    Returns a row per row of ``docs``: ``doc_id, n_words, n_hit, items``, with the
    words that lie in any occurrence of a window and the sorted ids of the items
    whose windows occur.  A shorter item that has words is one window.  Null and
    empty texts have no words; an item without words, and an empty benchmark, hit
    nothing.  Windows of items without an id count as hits under no id; items that
    share an id are one.  Rows of ``docs`` without an id and repeated rows each have
    a row.  Texts may be of any length.  Extra columns are not read.

    The windows are the stated queries: they are held against all segments in
    blocks of at most ``block``.
    """
    spark = docs.sparkSession
    windows = materialize(_item_windows(benchmark, size), "benchmark-windows")
    vocabulary = windows.select(F.explode(F.split("words", " ")).alias("term")).distinct()
    terms = [r.term.encode() for r in vocabulary.limit(MOST_TERMS + 1).collect()]
    index = build_index(docs, terms if len(terms) <= MOST_TERMS else None)
    blocks = max(1, -(-windows.count() // block))
    hits = None
    for number in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == number)
        found = _hits(index, [(r["words"], r["items"]) for r in part.collect()])
        hits = found if hits is None else hits.unionByName(found)
    by_document = (
        materialize(hits, "benchmark-hits")
        .groupBy("segment", "ordinal")
        .agg(covered(F.collect_set(F.struct("first", "stop"))).alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    )
    told = indexed_documents(index).join(by_document, ["segment", "ordinal"], "left")
    return told.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


ORACLE = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
  FROM lowered, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
hits AS (
  SELECT p.doc_id, p.i, p.size, v.item_id
  FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM places) p JOIN windows v USING (size, words)),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT l.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""
