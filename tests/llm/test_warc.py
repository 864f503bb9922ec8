import base64
import gzip
import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clicktide.llm import files, warc
from clicktide.plans.scratch import shared_folder


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    got = list(warc.LoserTree([(v, (v, i)) for v in r] for i, r in enumerate(runs)))
    assert got == sorted((v, i) for i, r in enumerate(runs) for v in r)


def pages(spark, rows):
    shared_folder(spark)
    full = [(i, u, h, "x", 1) for i, u, h in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, captured string, n int")


def expected(rows, least_bytes):
    first = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if page_id is not None and len(raw) >= least_bytes:
            first[raw] = min(first.get(raw, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        leader = first.get(raw, page_id) if page_id is not None and len(raw) >= least_bytes else page_id
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "response" if leader == page_id else "revisit",
                    None if leader == page_id else leader))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least_bytes", [0, 5])
@pytest.mark.parametrize("file_bytes", [1, 32 << 20])
def test_round_trip_and_order(spark, least_bytes, file_bytes):
    rng = random.Random(3)
    rows = [(i * 3 + 1, f"http://www.h{rng.randrange(4)}.example.com/{rng.randrange(5)}?q=\n%", rng.choice(["", "a", "same page", "é" * 9, f"p{i}\r\n\r\n"])) for i in range(80)]
    rows += [(None, None, None), (None, "no host", "same page"), (500, None, None), (501, "HTTPS://u@A.b:80", "x" * 200_000), (4, "http://a/", "same page"), (502, "", "\r\n\r\n")]
    df = pages(spark, rows)
    archives = warc.write_archives(df, F.timestamp_seconds(F.col("page_id") % 7), least_bytes, file_bytes)
    got = warc.capture_index(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows, least_bytes)
    ordered = sorted(got, key=lambda r: (r.slice, r.position))
    keys = [(r.url_key.encode(), r.captured, r.page_id is not None, r.page_id or 0) for r in ordered]
    assert keys == sorted(keys)
    urls = {(i, u) for i, u, _ in rows}
    assert {(r.page_id, r.url) for r in got} == urls
    one = next(r for r in got if r.page_id == 501)
    raw = files.read_bytes(one.run)[one.file_offset : one.file_offset + one.file_length]
    (headers, block, _, _), = warc.read_records(raw)
    assert headers["WARC-Target-URI"] == "HTTPS://u@A.b:80" and block.endswith(b"x" * 200_000)
    assert one.url_key == "b,a)/"


def test_rows_of_one_page_keep_their_own_payloads(spark):
    rows = [(1, "http://a/", "A"), (2, "http://a/", "A"), (2, "http://a/", "only here"), (3, "http://a/", "B")]
    rows += [(4, "http://a/", "A"), (4, "http://a/", "B"), (4, "http://a/", "A"), (1, "http://a/", "first page, too")]
    got = warc.capture_index(warc.write_archives(pages(spark, rows), F.lit(None))).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows, 0)


def archive_of(spark, rows, captured):
    archives = warc.write_archives(pages(spark, rows), captured)
    return archives, warc.capture_index(archives).collect()


def test_other_readers_can_read_the_archives(spark):
    urls = ["http://a.org/x%20y?q=%41", "http://a.org/line\nbreak", " http://a.org/ ", "http://a.org/é", None, ""]
    rows = [(i, u, "same" if i % 2 else f"page {i}") for i, u in enumerate(urls)] + [(0, urls[0], "page 0")] * 2 + [(None, None, "x")] * 2
    archives, index = archive_of(spark, rows, F.lit(None))
    assert sorted(((r.page_id, r.url) for r in index), key=repr) == sorted(((i, u) for i, u, _ in rows), key=repr)
    heads = []
    for row in archives.collect():
        raw = files.read_bytes(row.path)
        assert len(raw) == row.bytes
        # one pass of plain gzip gives every record
        heads += [part.split(b"\r\n\r\n")[0] for part in (b"\r\n\r\n" + gzip.decompress(raw)).split(b"\r\n\r\nWARC/1.1\r\n")[1:]]
        for r in (r for r in index if r.run == row.path):
            one = gzip.decompress(raw[r.file_offset : r.file_offset + r.file_length])
            assert one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC/1.1") == 1 and one.endswith(b"\r\n\r\n")
            assert f"WARC-Type: {r.record_type}\r\n".encode() in one
    ids = [line for head in heads for line in head.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == len(rows)
    uris = {line for head in heads for line in head.decode().split("\r\n") if line.startswith("WARC-Target-URI")}
    assert "WARC-Target-URI: http://a.org/x%20y?q=%41" in uris and "WARC-Target-URI: http://a.org/line%0Abreak" in uris


def test_times_of_any_year(spark):
    micros = [-62_135_596_800_000_000, -50_000_000_000_000_001, 0, 253_402_300_799_999_999, 260_000_000_000_000_000, -70_000_000_000_000_000]
    rows = [(i, f"http://a/{i}", "") for i in range(len(micros))]
    when = F.timestamp_micros(F.get(F.array(*[F.lit(m) for m in micros]), F.col("page_id").cast("int")))
    _, index = archive_of(spark, rows, when)
    told = {r.page_id: r.captured for r in index}
    assert [told[i] for i in range(4)] == micros[:4] and told[4] == micros[3] and told[5] == micros[0]


def test_equal_keys_are_cut_into_slices(spark):
    rows = [(None, "http://a/", "x")] * 500
    archives = warc.write_archives(pages(spark, rows), F.lit(None), file_bytes=2000)
    got = warc.merge_runs(warc.read_runs(archives), slice_rows=50).collect()
    assert len(got) == 500 and len({r.slice for r in got}) > 4
    ordered = [(r.run, r.seq) for r in sorted(got, key=lambda r: (r.slice, r.position))]
    assert ordered == sorted(ordered)


def test_empty_table(spark):
    archives = warc.write_archives(pages(spark, []), F.lit(None))
    assert warc.capture_index(archives).collect() == []
