"""Token ids as shards of patched frame-of-reference blocks.

A shard holds the ids of some consecutive documents, all in one sequence, cut
into blocks of 128.  Per block the smallest id is subtracted, the rest is packed
at the bit width that covers ``percentile`` of its values, and the values that
need more bits are listed as exceptions.  The index has every block's start, so
any block can be read alone.  Layout, little-endian:

    "PFOR" | u32 version | u64 ids | u32 blocks | u32 documents
    | u64 packed words | u64 exceptions
    | per block: u32 minimum, u8 width, u64 first word, u64 first exception
    | per document: i64 doc_id, u8 has an id, u64 ids
    | packed words (u64) | exception places (u8) | exception values (u32)

Documents are written in ascending doc_id order (without an id first, ties by
the hash of the text), shards are numbered in that order, and a catalogue table
gives each shard's file and the ids before it.
"""

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktide.llm import files
from clicktide.llm.common import documents, materialize, new_path, shuffle_partitions
from clicktide.llm.tokens import word_encoder

BLOCK = 128
_HEAD = np.dtype(
    [("magic", "S4"), ("version", "<u4"), ("ids", "<u8"), ("blocks", "<u4"), ("documents", "<u4"),
     ("words", "<u8"), ("exceptions", "<u8")]
)
_BLOCKS = np.dtype([("least", "<u4"), ("width", "u1"), ("word", "<u8"), ("exception", "<u8")])
_DOCS = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n", "<u8")])


# --- blocks -----------------------------------------------------------------


def _bit_length(values):
    """Bits needed for each value below 2**53."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray, percentile: float = 0.9):
    """Index, packed words, and places and values of the exceptions of ``ids``."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    rows = padded.reshape(blocks, BLOCK)
    least = rows.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = (rows - least[:, None]).astype(np.uint64)
    place = int(percentile * (BLOCK - 1))
    width = _bit_length(np.partition(rest, place, axis=1)[:, place]) if blocks else np.empty(0, np.int64)
    outlier = (rest >> width[:, None].astype(np.uint64)) > 0
    index = np.zeros(blocks, _BLOCKS)
    index["least"], index["width"] = least, width
    counts = 2 * width  # words of 64 bits for 128 values
    index["word"] = np.cumsum(counts) - counts
    found = outlier.sum(axis=1)
    index["exception"] = np.cumsum(found) - found
    words = np.zeros(int(counts.sum()), np.uint64)
    for w in np.unique(width):
        if w:
            group = np.flatnonzero(width == w)
            low = rest[group].T & np.uint64((1 << int(w)) - 1)
            packed = _shift_in(np.ascontiguousarray(low), int(w))
            words[index["word"][group][:, None].astype(np.int64) + np.arange(2 * w)] = packed.T
    at, inside = np.nonzero(outlier)
    return index, words, inside.astype(np.uint8), rest[at, inside].astype(np.uint32)


def _shift_in(values, w):
    packed = np.zeros((2 * w, values.shape[1]), np.uint64)
    for i in range(BLOCK):
        word, bit = divmod(i * w, 64)
        packed[word] |= values[i] << np.uint64(bit)
        if bit + w > 64:
            packed[word + 1] |= values[i] >> np.uint64(64 - bit)
    return packed


def unpack(index, words, places, values, first: int, last: int) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (not included)."""
    stop = int(index["exception"][last]) if last < len(index) else len(places)
    index = index[first:last]
    rest = np.zeros((len(index), BLOCK), np.uint64)
    for w in np.unique(index["width"]):
        w = int(w)
        if w:
            group = np.flatnonzero(index["width"] == w)
            packed = words[index["word"][group][:, None].astype(np.int64) + np.arange(2 * w)].T
            mask = np.uint64((1 << w) - 1)
            out = np.empty((BLOCK, len(group)), np.uint64)
            for i in range(BLOCK):
                word, bit = divmod(i * w, 64)
                out[i] = packed[word] >> np.uint64(bit)
                if bit + w > 64:
                    out[i] |= packed[word + 1] << np.uint64(64 - bit)
                out[i] &= mask
            rest[group] = out.T
    if len(index):
        here = np.arange(int(index["exception"][0]), stop)
        block = np.searchsorted(index["exception"].astype(np.int64), here, side="right") - 1
        rest[block, places[here]] = values[here]
    return (rest + index["least"][:, None]).astype(np.uint32).ravel()


def to_bytes(ids: np.ndarray, docs: np.ndarray, percentile: float = 0.9) -> bytes:
    index, words, places, values = pack(ids, percentile)
    head = np.zeros(1, _HEAD)
    head[0] = (b"PFOR", 1, len(ids), len(index), len(docs), len(words), len(places))
    parts = (head, index, docs, words.astype("<u8"), places, values.astype("<u4"))
    return b"".join(p.tobytes() for p in parts)


def parse(raw: bytes):
    """Document table, index and sections of a shard, without unpacking."""
    head = np.frombuffer(raw, _HEAD, 1)[0]
    if head["magic"] != b"PFOR" or head["version"] != 1:
        raise ValueError("not a token shard")
    at, out = _HEAD.itemsize, []
    for kind, n in ((_BLOCKS, head["blocks"]), (_DOCS, head["documents"]), ("<u8", head["words"]),
                    ("u1", head["exceptions"]), ("<u4", head["exceptions"])):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += out[-1].nbytes
    index, docs, words, places, values = out
    return docs, index, words, places, values, int(head["ids"])


def read_ids(raw: bytes, start: int, n: int) -> np.ndarray:
    """``n`` ids from ``start`` of a shard; only the blocks that hold them are unpacked."""
    _, *sections, total = parse(raw)
    stop = min(start + n, total)
    first = start // BLOCK
    return unpack(*sections, first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]


# --- writing and reading ----------------------------------------------------


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    percentile: float = 0.9,
    shard_ids: int = 1 << 22,
    latin_runs: bool = True,
) -> DataFrame:
    """Encode every text, write the shards and return their catalogue.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read.  A null
    or empty text has the end id alone.  Rows without an id come first; rows with
    the same id are kept one by one, ordered by text hash.  A shard ends after
    the document that brings it to ``shard_ids``; a document is never split.  An
    empty table has an empty catalogue and no shard.

    The catalogue has ``part``, ``seq``, ``path``, ``ids``, ``documents`` and
    ``before``, the ids of all earlier shards.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "token-shards")
    order = ["doc_id", F.xxhash64("text")]
    ranged = (
        documents(docs)
        .repartitionByRange(shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
    )
    write = partial(
        _write_shards, folder=folder, tokenizer=tokenizer, end_id=end_id,
        percentile=percentile, shard_ids=shard_ids, latin_runs=latin_runs,
    )
    shards = materialize(
        ranged.mapInArrow(write, "part int, seq int, path string, ids long, documents long"),
        "token-catalogue",
    )
    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("before", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


_CATALOGUE = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("ids", pa.int64()),
     ("documents", pa.int64())]
)


def _write_shards(batches, folder, tokenizer, end_id, percentile, shard_ids, latin_runs):
    encoder = word_encoder(tokenizer, latin_runs)
    end = int(end_id).to_bytes(4, "little")
    part, seq = TaskContext.get().partitionId(), 0
    rows, held, size = [], [], 0

    def flush():
        nonlocal seq, rows, held, size
        ids = np.frombuffer(b"".join(held), "<u4")
        path = files.new_name(folder, f"shard-{part:06d}-{seq:06d}")
        with files.create(path) as out:
            out.write(to_bytes(ids, np.array(rows, _DOCS), percentile))
        row = [[part], [seq], [path], [len(ids)], [len(rows)]]
        seq, rows, held, size = seq + 1, [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _CATALOGUE.types)], schema=_CATALOGUE)

    for batch in batches:
        texts = batch.column("text")
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            packed = encoder.encode(texts[i].as_py()) + end
            rows.append((doc_id or 0, doc_id is not None, len(packed) // 4))
            held.append(packed)
            size += len(packed) // 4
            if size >= shard_ids:
                yield flush()
    if rows:
        yield flush()


def read_tokens(catalogue: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document from the shards: ``doc_id, start, n_tokens, ids_crc32`` and ``ids``.

    ``start`` counts the ids of all documents before it, ``ids`` are the packed
    little-endian 32-bit ids and ``ids_crc32`` is their unsigned crc32.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    shards = catalogue.select("path", "before").repartition(shuffle_partitions(catalogue.sparkSession))
    return shards.mapInArrow(
        partial(_read_shards, with_ids=with_ids), schema + (", ids binary" if with_ids else "")
    )


def _read_shards(batches, with_ids):
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
            docs, *sections, _ = parse(files.read_bytes(path))
            ids = unpack(*sections, 0, len(sections[0]))
            ends = np.cumsum(docs["n"].astype(np.int64))
            starts = ends - docs["n"].astype(np.int64)
            raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)]
            columns = {
                "doc_id": pa.array(docs["doc_id"], mask=docs["known"] == 0),
                "start": pa.array(starts + before),
                "n_tokens": pa.array(docs["n"].astype(np.int64)),
                "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)
