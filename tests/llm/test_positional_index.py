import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from clicktide.llm import positional_index as index


def words(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(docs, items, size):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= owners
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


def tables(spark, docs, rows, items):
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, terms string")
    return docs(rows), benchmark


def random_rows(rng, n, vocabulary, longest):
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(longest)))) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"block": 7}])
def test_hits_equal_brute_force(spark, docs, sizes, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(index, "STARTS_AT_ONCE", 50)
    vocabulary = ["a", "a", "a", "B", "c", "D9", "é", "É", "日本"]
    rows = random_rows(rng, 120, vocabulary, 60) + [(500, None), (501, ""), (502, "a " * 3000), (None, "a b, C-d9"), (503, "x\x00y\x7fz")]
    rows += [rows[3], rows[3], (504, "é é"), (505, "a b")]
    items = random_rows(rng, 12, vocabulary, 12) + [(20, rows[0][1]), (21, rows[1][1]), (22, "a b"), (22, "日本 é"), (None, "D9 d9"), (23, None), (24, "!"), (25, "z")]
    got = index.benchmark_hits(*tables(spark, docs, rows, items), size=4, **sizes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == brute(rows, items, 4)


def test_windows_stay_within_documents(spark, docs):
    rows = [(i, "one two") for i in range(50)] + [(100, "one two one"), (101, "two")]
    items = [(1, "two one"), (2, "two one two one two one")]
    got = index.benchmark_hits(*tables(spark, docs, rows, items), size=10).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == brute(rows, items, 10)


def test_no_words_and_no_rows(spark, docs):
    some, none = [(1, "a b"), (2, None)], []
    assert index.benchmark_hits(*tables(spark, docs, none, [(1, "a")])).collect() == []
    assert {r.n_hit for r in index.benchmark_hits(*tables(spark, docs, some, none)).collect()} == {0}
    assert {r.n_hit for r in index.benchmark_hits(*tables(spark, docs, some, [(1, ""), (2, None)])).collect()} == {0}


def test_the_index_of_all_terms_gives_the_same(spark, docs, monkeypatch):
    rng = random.Random(9)
    rows, items = random_rows(rng, 60, list("abcdefgh"), 40), random_rows(rng, 9, list("abcdefgh"), 9)
    monkeypatch.setattr(index, "MOST_TERMS", 2)
    got = index.benchmark_hits(*tables(spark, docs, rows, items), size=3).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == brute(rows, items, 3)


def test_phrases_and_segments(spark, docs):
    rng = random.Random(2)
    rows = random_rows(rng, 80, list("abcd"), 30)
    made = index.build_index(docs(rows), segment_words=40)
    assert made.count() > 8
    phrases = [(b"a",), (b"a", b"b"), (b"c", b"c", b"c"), (b"d", b"a", b"d", b"b"), (b"z",), (b"a", b"z"), ()]
    told = index.indexed_documents(made)
    assert sorted((r.doc_id, r.n_words) for r in told.collect()) == [(i, len(words(t))) for i, t in rows]
    got = index.phrase_matches(made, phrases).join(told, ["segment", "ordinal"]).select("doc_id", "phrase", "start")
    want = []
    for i, text in rows:
        w = [x.encode() for x in words(text)]
        want += [(i, n, at) for n, p in enumerate(phrases) if p for at in range(len(w)) if tuple(w[at : at + len(p)]) == p]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("within", [1, 3, 6])
def test_proximity_equals_brute_force(spark, docs, within):
    rng = random.Random(within)
    rows = random_rows(rng, 60, list("aabbcdef"), 25)
    groups = [(b"a", b"e"), (b"f", b"d", b"c"), (b"c",), (b"b", b"b"), (b"a", b"z"), ()]
    made = index.build_index(docs(rows), segment_words=100)
    got = index.proximity_matches(made, groups, within).join(index.indexed_documents(made), ["segment", "ordinal"])
    want = set()
    for i, text in rows:
        w = [x.encode() for x in words(text)]
        for n, terms in enumerate(groups):
            spans = [(a, b) for a in range(len(w)) for b in range(a, min(a + within, len(w))) if terms and set(terms) <= set(w[a : b + 1])]
            want |= {(i, n, *s) for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)}
    assert {(r.doc_id, r.group, r.first, r.last) for r in got.collect()} == want and got.count() == len(want)


def test_covered(spark):
    rng = random.Random(1)
    cases = [[(a := rng.randrange(30), a + rng.randrange(9)) for _ in range(rng.randrange(7))] for _ in range(50)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, runs array<struct<first:long,stop:long>>")
    for r in df.select("i", index.covered(F.col("runs")).alias("n")).collect():
        assert r.n == len({p for a, b in cases[r.i] for p in range(a, b)})


def test_segments_searched_alone():
    # every window of a text is found in it, the pairs of equal starts included
    text = "a b a b a c a b"
    w = text.encode().split()
    columns = next(iter(index._write_segments(iter([_batch([text])]), _Sent(None), 1000))).to_pylist()[0]
    segment = index.Segment(columns)
    for a, b in combinations(range(len(w) + 1), 2):
        phrase, start = index.find_phrases(segment, index.Phrases([tuple(w[a:b])]))
        assert a in start.tolist() and set(phrase.tolist()) == {0}


class _Sent:
    def __init__(self, value):
        self.value = value


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})


@pytest.fixture(autouse=True)
def _partition_number(monkeypatch):
    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():  # noqa: N802
            return 0

    from pyspark import TaskContext

    if TaskContext.get() is None:
        monkeypatch.setattr(index, "TaskContext", Context)
