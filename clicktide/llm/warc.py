"""WARC archives of web pages, and the merge of their indexes.

Each task writes its captures, sorted by URL key and time, as one or more
``.warc.gz`` files (a gzip member per record).  Read back, a file is a locally
sorted run of index entries.  The runs are cut at the same keys into slices, and
each slice is merged from its k runs by a loser tree, so the slices in a row are
the capture histories of all URLs in order.
"""

import base64
import hashlib
import json
import re
import uuid
import zlib
from datetime import UTC, datetime, timedelta
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.llm import files
from clicktide.llm.common import materialize, new_path, shuffle_partitions
from clicktide.plans.skew import lookup_join

_SPACE = uuid.UUID("7b1e4c1e-2f0b-4a5e-9a55-0d2f6f6f9c11")  # names of record ids
_STEP = 8192
_JSON = "X-Json-"
_FIRST, _LAST = -62_135_596_800_000_000, 253_402_300_799_999_999  # microseconds of the years 1 to 9999
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host labels from the right, then the path: ``com,example)/a?b``; empty for a null URL.

    Scheme, user, port and a leading ``www.`` don't count, nor does the case of
    the host.  Text that has no host is its own key.
    """
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    key = F.when(host == "", url).otherwise(F.concat(labels, F.lit(")"), path))
    return F.coalesce(key, F.lit(""))


# --- roles ------------------------------------------------------------------


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Captures with the digest and size of their payload and, for revisits, the page, time and URL they refer to.

    Among equal payloads of at least ``least_bytes`` the smallest ``page_id`` is
    the response and the others refer to it.  The payload of revisits is null.
    Rows that share a ``page_id`` are judged each by its own payload.
    """
    html = F.coalesce("html", F.lit(""))
    payload = F.concat(F.sha1(html), F.lit("-"), F.octet_length(html))
    narrow = pages.where("page_id IS NOT NULL").select(
        "page_id", payload.alias("payload"), F.octet_length(html).alias("bytes"), "captured", "url"
    )
    firsts = (
        narrow.where(F.col("bytes") >= least_bytes)
        .groupBy("payload")
        .agg(F.min(F.struct("page_id", "captured", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    firsts = materialize(firsts, "repeated-payloads")  # read for its heaviest keys, too
    # one payload may be that of a large part of all pages
    found = lookup_join(narrow.select("page_id", "payload"), firsts, "payload", "n", ["page_id"])
    revisits = found.where("first.page_id <> page_id").select("page_id", "payload", F.col("first").alias("refers_to")).distinct()
    told = pages.select(
        "page_id", "url", url_key(F.col("url")).alias("url_key"), "captured", html.alias("html"),
        F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"), payload.alias("payload"),
    )
    return told.join(revisits, ["page_id", "payload"], "left").withColumn(
        "html", F.when(F.col("refers_to").isNull(), F.col("html"))
    )


# --- records ----------------------------------------------------------------


def record_id(path: str, seq: int) -> str:
    """No two records share an id: names of archives are unique."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{path}#{seq}')}>"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


_CONTROL = re.compile("[\x00-\x1f\x7f]")
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _plain(value: str) -> str:
    """A header value on one line: control characters as percent escapes, all else as it is."""
    return _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", value)


def _told(name: str, value: str) -> list[tuple[str, str]]:
    """A header, and where it can't hold the whole value that value as JSON in a second one."""
    plain = _plain(value)
    whole = plain == value and value == value.strip()
    return [(name, plain)] + ([] if whole else [(f"{_JSON}{name}", json.dumps(value))])


def _original(headers: dict, name: str) -> str | None:
    given = headers.get(f"{_JSON}{name}")
    return headers.get(name) if given is None else json.loads(given)


def _date(micros: int) -> str:
    moment = _EPOCH + timedelta(microseconds=micros)
    return moment.replace(tzinfo=None).isoformat(timespec="microseconds") + "Z"


def capture_record(name, page_id, url, key, captured: int, payload: bytes | None, sha1: str, size: int, refers_to):
    """The bytes of a record; ``refers_to`` is (page_id, captured, url) of a revisit's response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name),
        ("WARC-Date", _date(captured)),
        ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"),
        ("Content-Type", "application/http; msgtype=response"),
        *_told("X-Url-Key", key),
        ("X-Payload-Bytes", str(size)),
    ]
    if url is not None:
        headers += _told("WARC-Target-URI", url)
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        other, when, where = refers_to
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To-Date", _date(when)), ("X-Refers-To-Page-Id", str(other))]
        if where is not None:
            headers.append(("WARC-Refers-To-Target-URI", _plain(where)))
        return _record(headers, http + b"\r\n")
    return _record(headers, http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)


def read_records(raw: bytes):
    """``(headers, block, offset, stored length)`` of each gzip member of an archive."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        member, parts, end = zlib.decompressobj(wbits=31), [], at
        while not member.eof:  # in steps, for what is left over of the input is copied
            if end == len(raw):
                raise ValueError("the archive is cut off")
            step = view[end : end + _STEP]
            parts.append(member.decompress(step))
            end += len(step)
        end -= len(member.unused_data)
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines)
        block = rest[: int(headers["Content-Length"])]
        if not version.startswith("WARC/1.") or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield headers, block, at, end - at
        at = end


# --- writing and reading ----------------------------------------------------

_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_ENTRIES = pa.schema(
    [("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()), ("captured", pa.int64()),
     ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("file_offset", pa.int64()), ("file_length", pa.int64())]
)
_ENTRY_SCHEMA = (
    "run string, seq long, url_key string, captured long, page_id long, url string, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long, file_offset long, file_length long"
)


def write_archives(pages: DataFrame, captured: Column, least_bytes: int = 0, file_bytes: int = 32 << 20) -> DataFrame:
    """Write a record per page and return the table of archive files.

    ``pages`` needs ``page_id``, ``url`` and ``html`` (null: empty payload);
    ``captured`` is the time of the capture (null: 1970; before the year 1 or after
    9999: the first or last moment of those years).  Rows without a ``page_id`` are
    responses that nothing refers to; rows that share the smallest ``page_id`` of a
    payload are all responses.  Every row has a record with an id of its own, also
    among repeated rows.  A payload may be of any length that fits a task's memory.
    An empty table writes no file.
    """
    folder = new_path(pages.sparkSession, "archives")
    given = pages.select(
        pages["page_id"].cast("long").alias("page_id"), "url", "html",
        F.least(F.greatest(F.coalesce(F.unix_micros(captured.cast("timestamp")), F.lit(0)), F.lit(_FIRST)), F.lit(_LAST)).alias("captured"),
    )
    captures = with_roles(given, least_bytes).sortWithinPartitions("url_key", "captured", "page_id")
    captures = captures.select("page_id", "url", "url_key", "captured", "html", "sha1", "bytes", "refers_to")
    written = captures.mapInArrow(
        partial(_write_archives, folder=folder, file_bytes=file_bytes), "path string, records long, bytes long"
    )
    return materialize(written, "archive-files")


def _write_archives(batches, folder, file_bytes):
    out, path, records, size, part = None, None, 0, 0, TaskContext.get().partitionId()

    def close():
        out.close()
        return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]}, schema=_FILES)

    for batch in batches:
        columns = batch.columns
        for row in range(batch.num_rows):
            page_id, url, key, micros, html, sha1, n, refers_to = (c[row].as_py() for c in columns)
            if out is None:
                path, records, size = files.new_name(folder, f"captures-{part:06d}") + ".warc.gz", 0, 0
                out = files.create(path)
            payload = html.encode() if html is not None else None
            other = tuple(refers_to.values()) if refers_to is not None else None
            raw = capture_record(record_id(path, records), page_id, url, key, micros, payload, sha1, n, other)
            member = zlib.compressobj(4, zlib.DEFLATED, 31)
            packed = member.compress(raw) + member.flush()
            out.write(packed)
            records, size = records + 1, size + len(packed)
            if size >= file_bytes:
                yield close()
                out = None
    if out is not None:
        yield close()


def read_runs(archives: DataFrame) -> DataFrame:
    """An index entry per record, read from the archives; payloads are checked against their digests."""
    spread = archives.select("path").repartition(shuffle_partitions(archives.sparkSession))
    return spread.mapInArrow(_read_runs, _ENTRY_SCHEMA)


def _read_runs(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = []
            for seq, (headers, block, offset, length) in enumerate(read_records(files.read_bytes(path))):
                kind, size = headers["WARC-Type"], int(headers["X-Payload-Bytes"])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if len(payload) != size or base32(hashlib.sha1(payload).hexdigest()) != digest:
                        raise ValueError(f"a payload in {path} differs from its digest")
                since = datetime.fromisoformat(headers["WARC-Date"]) - _EPOCH
                micros = (since.days * 86400 + since.seconds) * 1_000_000 + since.microseconds
                page_id, other = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                rows.append(
                    (path, seq, _original(headers, "X-Url-Key"), micros, page_id and int(page_id),
                     _original(headers, "WARC-Target-URI"), size, digest, kind, other and int(other), offset, length)
                )
            yield _batch(rows, _ENTRIES)


def _batch(rows, schema):
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


# --- the merge --------------------------------------------------------------


class LoserTree:
    """Merges sorted runs of ``(key, item)``; each step replays one path from a leaf to the root."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = len(self.runs)
        self.losers = [-1] * max(k, 1)  # losers[0] holds the winner
        for leaf in range(k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[0] < y[0] or (x[0] == y[0] and a < b)

    def _replay(self, leaf: int):
        winner, node = leaf, (leaf + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # first match at this node waits for the second
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.runs:
            winner = self.losers[0]
            if self.heads[winner] is None:
                return
            yield self.heads[winner][1]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


_MERGED = _ENTRIES.append(pa.field("slice", pa.int32())).append(pa.field("position", pa.int64()))


SLICE_ROWS = 400_000


def merge_runs(runs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """All entries with ``slice`` and ``position``, in whose order they are sorted by URL key, time and page.

    Slices are ranges of the whole key and, among equal keys, of run and place, so
    captures of one URL, or rows that share all of the key, may take several.  They
    have about ``slice_rows`` entries at most.  A task holds those as Arrow buffers,
    no payloads, and turns some rows of each run at a time into keys for the tree.
    """
    slices = max(shuffle_partitions(runs.sparkSession), -(-runs.count() // slice_rows))
    ranged = runs.repartitionByRange(
        slices, "url_key", "captured", "page_id", "run", "seq"
    ).sortWithinPartitions("run", "seq")
    return ranged.mapInArrow(_merge_slice, _ENTRY_SCHEMA + ", slice int, position long")


def _stretches(batches):
    """Each run's rows as pieces of Arrow batches, in order."""
    runs: dict[str, list] = {}
    for batch in batches:
        names = batch.column("run").to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                runs.setdefault(names[a], []).append(batch.slice(a, b - a))
    return runs.values()


def _keyed(pieces, step=256):
    for piece in pieces:
        for at in range(0, piece.num_rows, step):
            for row in zip(*(c.to_pylist() for c in piece.slice(at, step).columns)):
                # entries without a page sort first, as in the runs
                yield (row[2].encode(), row[3], row[4] is not None, row[4] or 0), row


def _merge_slice(batches):
    part, rows, position = TaskContext.get().partitionId(), [], 0
    for row in LoserTree([_keyed(pieces) for pieces in _stretches(batches)]):
        rows.append((*row, part, position))
        position += 1
        if len(rows) == 10_000:
            yield _batch(rows, _MERGED)
            rows = []
    if rows:
        yield _batch(rows, _MERGED)


def capture_index(archives: DataFrame) -> DataFrame:
    """The merged index of written archives."""
    return merge_runs(materialize(read_runs(archives), "index-runs"))
