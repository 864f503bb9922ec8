import random

import pytest
from pyspark.sql import functions as F

from clicktide.llm import line_dedup

WHITE = " \t\n\x0b\f\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, least=10):
    last = (1, 0)

    def rank(doc_id):
        return last if doc_id is None else (0, doc_id)

    owner = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = key_of(line)
            if len(key) >= least:
                owner[key] = min(owner.get(key, last), rank(doc_id))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(key_of(x), rank(doc_id)) == rank(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def dedup(frame):
    return sorted((tuple(r) for r in line_dedup.dedup_lines(frame).collect()), key=repr)


def test_cases(spark, docs):
    rows = [
        (5, "Shared line of text\nown line number five\n  SHARED LINE OF TEXT\t"),
        (3, "\x0bshared line of text\r\nshared line of text"),
        (9, None), (10, ""), (11, "\n"), (12, "shared line of text"), (13, "short\nshort"), (14, "short"),
        (20, "É grand écran x\nÀ part"), (21, "é grand écran x"), (22, "É GRAND éCRAN X"),
        (23, "KKKKKKKKKKKK"), (24, "kkkkkkkkkkkk"), (25, "ten chars!\nnine char"), (26, "TEN CHARS!\nnine char"),
        (30, "\n".join(f"a line that is number {i}" for i in range(200)) + "\n"),
        (31, "\n".join(f"a line that is number {i}" for i in range(0, 400, 3))),
        (40, "twice the same id\nx"), (40, "twice the same id\nother"), (40, "twice the same id\nother"),
        (None, "twice the same id\nonly without an id"), (None, "only without an id"),
        (50, "\x00 nul and more \x00\n" * 3), (51, "\x00 nul and more \x00"), (52, "日本語の長い行です。とても\n" * 2), (53, "日本語の長い行です。とても"),
    ]
    assert dedup(docs(rows)) == brute(rows)


@pytest.mark.parametrize("hot_share", [1, 3, 10**9])
def test_random_tables_with_hot_lines(spark, docs, monkeypatch, hot_share):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", hot_share)
    rng = random.Random(hot_share)
    pool = ["everyone has this line", *(f"line {i} of the common pool" for i in range(30))]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"unique {i} {j} {rng.random()}" for j in range(rng.randrange(1, 90)))) for i in range(120)]
    assert dedup(docs(rows)) == brute(rows)


def test_bitmaps_hold_only_words_that_change(spark, docs):
    lines = [f"a line that is number {i}" for i in range(640)]
    rows = [(1, lines[3] + "\n" + lines[500]), (2, "\n".join(lines))]
    (row,) = line_dedup.keep_bitmaps(docs(rows)).collect()
    assert (row.doc_id, row.n_dropped) == (2, 2)
    assert [(w.word, w.bits) for w in row.keep] == [(0, ~(1 << 3)), (7, ~(1 << 52))]


def test_empty_table_and_no_repeats(spark, docs):
    assert dedup(docs([])) == []
    rows = [(1, "one line that is long"), (2, "another line that is long")]
    assert dedup(docs(rows)) == brute(rows)


def test_owner_of_each_key_is_unique(spark, docs):
    rows = [(i, f"shared by all of them\nown {i:09d}") for i in range(50)]
    kept = line_dedup.dedup_lines(docs(rows)).where(F.col("kept").contains("shared by all")).count()
    assert kept == 1


def test_ranges_need_one_shuffle_and_no_python(spark, docs):
    lines = line_dedup.hashed_lines(docs([(1, "a line that is long\nb"), (2, "a line that is long")]))
    plan = line_dedup.dropped_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan
    assert "Python" not in plan and "Arrow" not in plan


