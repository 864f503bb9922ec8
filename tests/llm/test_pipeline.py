import importlib

import pytest
import regex
from test_jaccard_join import brute as brute_components
from test_line_dedup import brute as brute_lines
from test_packing import check_layout

import corpus_pipeline
from clicktide.llm import surrogates, toxicity
from clicktide.llm.common import materialize
from clicktide.llm.queries import QUERIES, WORD_TOKENIZER
from clicktide.llm.tokens import word_encoder
from clicktide.plans.scratch import shared_folder

SF = "/root/testdata/sf0.001"
MENTION = regex.compile(surrogates.MENTION, regex.ASCII)


def as_dict(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, on the smallest tables."""
    shared_folder(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), name)
        out[name] = docs, after
        docs = after
    return out


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_duplicates", "personal_data", "packing"
    ]


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(before, model).where("predicted = 1").collect()}
    rows = as_dict(before)
    assert bad and as_dict(after) == {i: r for i, r in rows.items() if i not in bad}


def test_lines_go(stages):
    before, after = stages["line_dedup"]
    assert before.columns == after.columns
    want = {i: kept for i, _, _, kept in brute_lines([(r.doc_id, r.text) for r in before.collect()])}
    got = as_dict(after)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert {i: (r.lang, r.source) for i, r in got.items()} == {i: (r.lang, r.source) for i, r in as_dict(before).items()}


def test_one_of_each_stays(stages):
    before, after = stages["near_duplicates"]
    rows = as_dict(before)
    kept = {i for i, _, component in brute_components([(r.doc_id, r.text) for r in rows.values()]) if i == component}
    assert as_dict(after) == {i: rows[i] for i in kept}


def test_personal_data_goes(stages):
    before, after = stages["personal_data"]
    old, new = as_dict(before), as_dict(after)
    assert set(old) == set(new) and before.columns == after.columns
    real = {m for r in old.values() for m in MENTION.findall(r.text)}
    assert real
    for i, r in new.items():
        if not MENTION.search(old[i].text):
            assert r == old[i]
        assert not real & set(MENTION.findall(r.text)) and r.n_chars == len(r.text)


def test_packed_ids_are_the_documents(stages):
    before, after = stages["packing"]
    encoder = word_encoder(WORD_TOKENIZER)
    whole = {r.doc_id: encoder.encode(r.text) + b"\1\0\0\0" for r in before.collect()}
    pieces = after.collect()
    check_layout([(0, p.length, p.sequence_id, p.offset) for p in pieces], sum(map(len, whole.values())) // 4, 2048)
    found = {i: b"" for i in whole}
    for p in sorted(pieces, key=lambda p: p.start):
        found[p.doc_id] += bytes(p.ids)
    assert found == whole


def test_odd_tables(spark):
    """Null ids and texts, repeated rows and columns with the names used inside."""
    shared_folder(spark)
    schema = "text string, row int, doc_id long, others string, kept string, n_chars long, score double, component_id long"
    rows = [
        ("one line of text here\nanother line of text", 1, 1, "o", "k", 0, 0.5, 9),
        (None, 2, 2, None, None, None, None, None), ("", 3, 3, "o", "k", 0, 0.5, 9),
        ("no id, mail a@b.org, one line of text here", 4, None, "o", "k", 0, 0.5, 9),
        ("same id and text\nmail c@d.org please now", 5, 4, "o", "k", 0, 0.5, 9),
        ("same id and text\nmail c@d.org please now", 5, 4, "o", "k", 0, 0.5, 9),
    ]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            if name != "packing":
                assert after.columns == docs.columns, name
            docs = materialize(after, name)
        assert (docs.count() > 0) == bool(data)


def test_one_row_of_each_stays_without_ids_and_with_shared_ids(spark, docs):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (None, a), (1, a), (None, a + " more"), (2, b), (2, a), (3, c), (None, d), (None, d), (None, None), (4, ""), (5, b)]
    before = docs(rows)
    after = corpus_pipeline.keep_one_of_each(spark, before, SF)
    assert after.columns == before.columns
    got = sorted(((r.doc_id, r.text) for r in after.collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (None, d), (None, None), (4, "")], key=repr)


def test_run_is_registered():
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
