import random
import zlib

import numpy as np
import pytest

from clicktide.llm import toxicity
from clicktide.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    values = np.asarray(scores)[order]
    for v in np.unique(values):
        at = np.flatnonzero(values == v)
        ranks[order[at]] = at.mean() + 1
    labels = np.asarray(labels)
    p = labels.sum()
    return (ranks[labels == 1].sum() - p * (p + 1) / 2) / (p * (len(labels) - p))


def test_held_out_accuracy(spark):
    scored = QUERIES["op8_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert auc([r.score for r in unseen], [r.toxic for r in unseen]) > 0.97
    hit = sum(r.toxic and r.predicted for r in unseen)
    assert hit / sum(r.toxic for r in unseen) > 0.9
    assert hit / max(1, sum(r.predicted for r in unseen)) > 0.9


def test_features_are_defined_for_any_text():
    lexicon = toxicity.Lexicon(5, 5, {"bad": 1, "vile*": 2}, np.array([[0, 0], [4, 0], [3, 1.0]]))
    marks = toxicity._Words(lexicon)
    for text in ["", " ", "\x00", "YOU are so BAD!!!", "b@d vileness 1d1ot", "x" * 100_000, "日本 😀 ...", "é" * 10 + "\n" * 9]:
        values = toxicity.text_features(text, marks)
        assert len(values) == len(toxicity.FEATURES) and np.isfinite(values).all()
    told = dict(zip(toxicity.FEATURES, toxicity.text_features("you are bad, 1d1ot", marks)))
    assert told["hits_near_address"] == 1 and told["fixed_hits"] > 0 and told["hidden_hits"] > 0
    own = toxicity.text_features("bad", marks, own=1)
    assert own[4] < toxicity.text_features("bad", marks)[4]


def rows(docs, labels, spark):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = toxicity.fit(docs, table)
    return {r.doc_id: r for r in toxicity.score(docs, model).collect()}, model


@pytest.mark.parametrize("kind", ["none", "one class", "tiny"])
def test_few_labels(spark, docs, kind):
    rng = random.Random(1)
    made = [(i, ("vermin " if i % 3 == 0 else "nice ") + " ".join(rng.choice("abcdefgh") * 3 for _ in range(9))) for i in range(60)]
    frame = docs([*made, (None, "vermin"), (1000, None), (1001, ""), (1002, "y " * 30_000)])
    labels = {"none": [], "one class": [(i, 1, 0, "t") for i in range(60)], "tiny": [(i, 1, int(i % 3 == 0), "t") for i in range(60)] + [(3, 1, 1, "t"), (4, 0, None, "t"), (None, 1, 1, "t"), (5000, 1, 1, "t")]}[kind]
    got, model = rows(frame, labels, spark)
    assert len(got) == 64 and all(0 <= r.score <= 1 for r in got.values())
    assert got[None].held_out
    if kind == "none":
        assert {r.score for r in got.values()} == {0.0}
    if kind == "tiny":
        assert np.mean([got[i].score for i in range(0, 60, 3)]) > np.mean([got[i].score for i in range(1, 60, 3)])


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    frame = docs([(i, f"word{i % 7} vermin{i % 5} text") for i in range(80)])
    labels = [(i, 1, int(i % 5 == 0), "t") for i in range(80)]
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, x) for i, q, t, x in labels]
    a, _ = rows(frame, labels, spark)
    b, _ = rows(frame, turned, spark)
    assert {k: r.score for k, r in a.items()} == {k: r.score for k, r in b.items()}


def test_empty_table(spark, docs):
    got, _ = rows(docs([]), [(1, 1, 1, "t")], spark)
    assert got == {}


