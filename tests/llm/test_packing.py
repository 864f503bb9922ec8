import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clicktide.llm import packing
from clicktide.llm.queries import WORD_TOKENIZER
from clicktide.llm.tokens import word_encoder


def check_layout(parts, total, window):
    """Every sequence is gapless from 0, and full or a power of two; nothing is lost."""
    by = defaultdict(list)
    for _, n, sequence, offset in parts:
        by[sequence].append((offset, n))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        size = sum(n for _, n in spans)
        assert size <= window and size & (size - 1) == 0
    assert sum(n for _, n, _, _ in parts) == total
    return by


@settings(max_examples=80, deadline=None)
@given(st.sampled_from([4, 16, 64]), st.data())
def test_plan_places_every_id_once(window, data):
    counts = data.draw(st.lists(st.integers(0, 30), min_size=window, max_size=window))
    histogram = np.array([0, *counts])
    plan = packing.make_plan(histogram, window)
    parts = [p for n, c in enumerate(histogram) for r in range(c) for p in packing.place_piece(plan, n, r)]
    by = check_layout(parts, int((histogram * np.arange(window + 1)).sum()), window)
    assert sorted(by) == list(range(plan.sequences))


def test_least_squares_uses_combinations():
    rng = np.random.default_rng(1)
    window = 256
    histogram = np.bincount(rng.integers(1, window, 20000), minlength=window + 1)
    ways = packing.combinations(np.flatnonzero(histogram), window)
    assert (ways.sum(axis=1) == window).all()
    plan = packing.make_plan(histogram, window)
    whole = plan.tape_rank.sum() / histogram.sum()
    assert whole > 0.9  # most rests are in an exact combination, uncut


@pytest.mark.parametrize("window", [8, 2048])
def test_table(spark, docs, window):
    encoder = word_encoder(WORD_TOKENIZER)
    rows = [(i, "the cat sat on a mat " * (i % 37) + "x" * (i % 11)) for i in range(200)]
    rows += [(500, None), (501, ""), (None, "a b"), (502, "same"), (502, "same"), (503, "one two " * 4000)]
    got = packing.pack_documents(docs(rows), WORD_TOKENIZER, end_id=1, window=window).collect()
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append(encoder.encode(text or "") + b"\1\0\0\0")
    check_layout([(0, r.length, r.sequence_id, r.offset) for r in got], sum(len(w) // 4 for v in want.values() for w in v), window)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        found[r.doc_id].append(r)
    for doc_id, texts in want.items():
        if len(texts) == 1:
            pieces = found[doc_id]
            assert b"".join(bytes(p.ids) for p in pieces) == texts[0]
            assert all(p.doc_tokens == len(texts[0]) // 4 for p in pieces)
            assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]]))
    assert len(found[502]) >= 2


def test_empty_table(spark, docs):
    assert packing.pack_documents(docs([]), WORD_TOKENIZER, end_id=1).collect() == []
