import random
import re
from collections import Counter, defaultdict

import pytest

from clicktide.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield re.findall("[^\x20\x09]+", piece)


def brute(rows, least, top, longest=4):
    out = []
    by_lang = defaultdict(list)
    for lang, text in rows:
        by_lang["und" if lang is None else lang].append(text)
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for w in pieces(text):
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, 3, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string")
    return sorted(tuple(r) for r in collocations.collocations(df.repartition(3), **options).collect())


def random_texts(rng, n):
    words = ["the", "The", "of", "New", "york", "a\x00b", "é", "É", "日本", "x-y", "\x0b", "city.", "hall,", "\t", "q"]
    return [(rng.choice(["en", "en", "de", None, ""]), " ".join(rng.choices(words, k=rng.randrange(40)))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"trigger": 1}, {"trigger": 10**9}, {"bits": 3}, {"top": 4}])
def test_equals_brute_force(spark, docs, options, monkeypatch):
    docs([])
    rng = random.Random(7)
    rows = random_texts(rng, 150) + [("en", None), ("en", ""), (None, "one two  three\tfour " * 50), ("fr", "a b " * 400), ("es", "a")]
    rows += [("de", "same passage of eight words in every copy")] * 40
    want = brute(rows, 12, options.get("top", 2000))
    assert len(want) > 15 and run(spark, rows, least=12, **options) == want


def test_blocks_of_any_size_give_the_same(spark, docs, monkeypatch):
    docs([])
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 60)
    monkeypatch.setattr(collocations, "MOST_OWNED", 3)
    rows = random_texts(random.Random(3), 80) + [("en", "to be or not to be " * 300)]
    assert run(spark, rows, least=6) == brute(rows, 6, 2000)


def test_a_chunk_owns_each_word_once():
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join(rng.choices(["a", "b", "c", ".", "dd"], k=rng.randrange(60)))
        words = collocations._words(text.encode())
        made = collocations.chunks_of(words, 4, {b"a": False, b"b": True, b"c": False, b"dd": True, b"\n": False})
        owned = [w for n, chunk in made for w in chunk.split(b" ")[:n] if w]
        assert owned == words
        assert all(len(chunk.split(b" ")) <= n + 3 and b"\n" not in chunk.split(b" ")[n:] for n, chunk in made)


def test_equal_passages_share_chunks(spark, docs):
    docs([])
    passage = " ".join(f"word{i}" for i in range(400))
    rows = [("en", f"start{i} other{i} {passage}") for i in range(30)]
    df = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    parsed = collocations.parse(df)
    # the 30 beginnings differ, the rest of the parse is one dictionary
    assert parsed.count() < 30 * 3 + 400 and parsed.selectExpr("sum(n * owned)").first()[0] == 30 * 402


def test_empty_tables(spark, docs):
    assert run(spark, []) == [] and run(spark, [("en", None), (None, "")], least=1) == []
    assert collocations.collocations(docs([(1, "a b a b")]).drop("lang"), least=2).select("lang").first()[0] == "und"
