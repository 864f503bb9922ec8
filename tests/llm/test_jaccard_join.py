import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clicktide.llm import common, jaccard_join
from clicktide.llm import shingles as sh
from clicktide.llm.components import components
from clicktide.plans.scratch import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def union(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = [(i, brute_set(t)) for i, t in rows]
    usable = [(i, s) for i, s in sets if i is not None and s]
    links = [(i, j) for (i, a), (j, b) in combinations(usable, 2) if 100 * len(a & b) >= 80 * len(a | b)]
    root = union({i for i, _ in usable}, links)
    return sorted(((i, len(s), root[i] if i is not None and s else i) for i, s in sets), key=repr)


def joined(df):
    return sorted((tuple(r) for r in jaccard_join.near_duplicates(df).collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abAB é\n\t\x0b\x1c\x85　", max_size=60), min_size=1, max_size=6))
def test_shingle_sets_have_the_right_sizes_and_overlaps(texts):
    got, want = sh.shingle_sets(texts), [brute_set(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for (a, x), (b, y) in combinations(zip(got, want), 2):
        assert sh.common(a, b) == len(x & y)
        assert sh.least_difference(sh.class_counts(a), sh.class_counts(b)) <= len(x ^ y)
        assert (sh.set_signature(a) == sh.set_signature(b)) == (x == y)


def test_long_texts_in_chunks(monkeypatch):
    texts = ["", "a b c d e f " * 200, "x", " ", "q w e r t y " * 3000]
    whole = sh.shingle_sets(texts)
    monkeypatch.setattr(sh, "_CHUNK", 50)
    assert all((a == b).all() for a, b in zip(whole, sh.shingle_sets(texts)))


def variants(rng, words, size, changes):
    """A text and near copies of it, each with some words replaced."""
    base = [rng.choice(words) + str(rng.randrange(10**6)) for _ in range(size)]
    out = [" ".join(base)]
    for change in changes:
        copy = list(base)
        for at in rng.sample(range(size), min(size, change)):
            copy[at] = f"new{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon".split()
    passage = " ".join(f"passage{i}" for i in range(55))
    texts = []
    for _ in range(12):
        texts += variants(rng, words, rng.choice([6, 30, 120]), [rng.randrange(6) for _ in range(rng.randrange(6))])
    chain = [f"link{i}" for i in range(60)]
    for i in range(10):  # neighbours are near, the ends are not
        texts.append(" ".join(chain[i : i + 45]))
    texts += [f"{passage} own{i} " + " ".join(f"w{rng.random()}" for _ in range(rng.randrange(1, 90))) for i in range(25)]
    texts += [passage] * 3 + ["one", "ONE", "one two", "Two one", "", " \n", "a b c d", "a b c d e", "a B c d  e"]
    rng.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("settings_", [{}, {"BLOCK": 3, "FREQUENT": 4, "SMALL": 2}])
def test_equals_brute_force(spark, docs, monkeypatch, settings_):
    if settings_:
        monkeypatch.setattr(common, "SENT_IDS", 0)
    for name, value in settings_.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(len(settings_))
    rows += [(None, "alpha " * 9), (None, rows[0][1]), (9001, None), (9002, "x y " * 20_000), (9003, "x y " * 20_001)]
    rows += [(9010, rows[1][1]), (9010, rows[1][1]), (9011, rows[3][1]), (9011, "something else entirely in this row here")]
    assert joined(docs(rows)) == brute(rows)


def test_two_clusters_that_only_an_outer_pair_links(spark, docs):
    # p links a, q links b, and a links b, though neither pivot sees that
    base = [f"w{i}" for i in range(100)]

    def text(first, last):
        return " ".join(base[first:last])

    rows = [(1, text(0, 60)), (2, text(8, 66)), (3, text(16, 74)), (4, text(24, 82)), (5, text(32, 90)), (6, text(60, 100))]
    assert joined(docs(rows)) == brute(rows)


def test_large_group_of_near_copies_links_in_a_star(spark, docs):
    rng = random.Random(3)
    rows = list(enumerate(variants(rng, ["w"], 150, [rng.randrange(1, 4) for _ in range(299)])))
    got = joined(docs(rows))
    assert {r[2] for r in got} == {0}


def test_pivots_take_one_shuffle_of_the_shingles(spark):
    rows = [(3, 10), (1, 10), (2, 10), (2, 11), (5, 11), (9, 12), (7, 13), (7, 13), (2, 14), (5, 14)]
    pairs = jaccard_join._pivot_pairs(spark.createDataFrame(rows, "doc_id long, shingle long"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(shingle") == 1
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (2, 5)]


def test_data_of_a_pivot_is_sent_once_for_few_pairs(spark):
    few = [(p, 1000 * p + k) for p in range(20) for k in range(1, 6)]
    many = [(99, 10_000 + k) for k in range(40 * jaccard_join.STAR)]
    blocks = {}
    for p, x, block in jaccard_join._dealt(spark.createDataFrame(few + many, "p long, x long"), 8).collect():
        blocks.setdefault(p, set()).add(block)
    assert all(len(blocks[p]) == 1 for p in range(20)) and blocks[99] == set(range(8))


def test_documents_far_in_size_are_not_compared(spark, docs, monkeypatch):
    """Texts that share a line but not their size: sizes tell most of them apart."""
    rng = random.Random(12)
    line = [f"l{i}" for i in range(8)]

    def text(k):
        return " ".join(line + [f"w{k}x{i}" for i in range(rng.choice([0, 12, 60, 240]))])

    rows = [(k, text(k)) for k in range(60)]
    rows += [(100 + k, v) for k, v in enumerate(variants(rng, ["n"], 80, [1, 2, 3, 4]))]
    rows += [(7, text(500)), (7, rows[3][1])]  # an id with sets of several sizes
    sent, star = [], jaccard_join._star

    def watched(pairs, *args):
        sent.append({tuple(r) for r in pairs.collect()})
        return star(pairs, *args)

    monkeypatch.setattr(jaccard_join, "_star", watched)
    assert joined(docs(rows)) == brute(rows)
    sizes = {}
    for doc_id, s in zip([r[0] for r in rows], sh.shingle_sets([r[1] for r in rows])):
        sizes.setdefault(doc_id, []).append(len(s))
    beyond = jaccard_join.Threshold(80, 100).beyond
    for p, x in sent[0]:
        assert any(not beyond(abs(a - b), a + b) for a in sizes[p] for b in sizes[x])


def test_regions_lose_documents_of_a_size_of_their_own(spark):
    rows = [(1, 10, 5), (1, 11, 5), (1, 12, 5), (1, 13, 5), (2, 10, 2), (2, 14, 2), (3, 15, jaccard_join.SORTED + 1)]
    of = [(10, 100), (11, 80), (12, 300), (13, 10), (13, 376), (14, 79), (15, 7)]
    dealt = spark.createDataFrame(rows, "p long, x long, rows long")
    got = jaccard_join._met_by_size(dealt, spark.createDataFrame(of, "doc_id long, n long"), jaccard_join.Threshold(80, 100))
    assert sorted(r[:2] for r in got.collect()) == [(1, 10), (1, 11), (3, 15)]
    of[5] = (13, 375)  # 300 is 80 % of it
    got = jaccard_join._met_by_size(dealt, spark.createDataFrame([*of, (13, 375)], "doc_id long, n long"), jaccard_join.Threshold(80, 100))
    assert (1, 12) in [r[:2] for r in got.collect()] and (1, 13) in [r[:2] for r in got.collect()]


def test_copies_with_ids_that_have_other_sets(spark, docs):
    rng = random.Random(5)
    a, b, c = ([f"{k}{rng.randrange(10**6)}" for _ in range(60)] for k in "abc")
    near = [*a[:-1], "other"]
    rows = [(i, " ".join(w)) for i, w in [(4, a), (6, a), (6, b), (2, b), (9, near), (8, near), (7, c), (8, c)]]
    assert joined(docs(rows)) == brute(rows)


def test_empty_table(spark, docs):
    assert joined(docs([])) == []
    assert joined(docs([(1, ""), (2, "")])) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("small", [2, 10**9])
def test_blocks_by_voronoi_regions_lose_no_pair(monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rng = random.Random(9)
    texts = [t for _ in range(25) for t in variants(rng, ["w"], rng.choice([40, 60, 90]), [1, 2, 3])]
    sets = sh.shingle_sets(texts)
    threshold = jaccard_join.Threshold(80, 100)
    sizes, counts = [len(s) for s in sets], [sh.class_counts(s) for s in sets]
    got = jaccard_join.near_pairs(sizes, counts, threshold)
    linked = {(i, j) for i, j in combinations(range(len(sets)), 2) if threshold.links(sh.common(sets[i], sets[j]), sizes[i] + sizes[j])}
    assert linked and linked <= got and len(got) < 4 * len(linked)
    half = len(sets) // 2
    across = jaccard_join.near_pairs(sizes, counts, threshold, np.arange(half), np.arange(half, len(sets)))
    assert {p for p in linked if p[0] < half <= p[1]} <= across
    assert all(i < half <= j for i, j in across)


def test_components(spark):
    shared_folder(spark)
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    frame = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in links], "u long, v long")
    got = {r.node: r.component for r in components(frame).collect()}
    nodes = {n for link in links if link[0] != link[1] for n in link}
    assert got == union(nodes, links)
    assert components(frame.limit(0)).collect() == []
