import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clicktide.llm import files, token_blocks, tokens
from clicktide.llm.queries import WORD_TOKENIZER
from clicktide.llm.tokens import word_encoder

ODD = [
    "", " ", "a", "The cat's  HAT\tisn't\n\n2024²x", "É é é İstanbul ſ K ΑΣ", "<|endoftext|> a<|startoftext|>", "a <|endoftext|> b", "it's<|endoftext|>'s", "<|ENDOFTEXT|> <|endoftext |>",
    "é<|endoftext|><|endoftext|>É", "<|endoftext", "|>",
    "\x00\x1c\x85\xa0b", "日本語 テスト😀👍🏽", "x" * 5000, "a" * 63 + " " + "é" * 70, "don't 'S ''ll we'LL´s", "½①Ⅷ٣ 12.5",
    "́abc ́", "ŉ ŀ ĳ ß ẞ", "a b　c",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_words_are_encoded_as_the_library_does(library):
    for text in ODD:
        got = np.frombuffer(word_encoder(WORD_TOKENIZER).encode(text), "<u4")
        assert got.tolist() == ids_of(library, text), text


def test_long_texts_by_stretches(library, monkeypatch):
    monkeypatch.setattr(tokens, "_STRETCH", 5)
    for text in ODD + ["one  two don't\nstop " * 30]:
        got = np.frombuffer(word_encoder(WORD_TOKENIZER).encode(text), "<u4")
        assert got.tolist() == ids_of(library, text), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text_is_encoded_as_the_library_does(library, text):
    assert np.frombuffer(word_encoder(WORD_TOKENIZER).encode(text), "<u4").tolist() == ids_of(library, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "a", "É", " ", "\n", "'s", "endoftext", "7"]), max_size=12))
def test_special_tokens_as_the_library_finds_them(library, parts):
    text = "".join(parts)
    assert np.frombuffer(word_encoder(WORD_TOKENIZER).encode(text), "<u4").tolist() == ids_of(library, text)


def test_a_very_long_text(library):
    line = "one two <|endoftext|>don't \u00c9t\u00e9\n"
    text = line * 60_000
    got = np.frombuffer(word_encoder(WORD_TOKENIZER).encode(text), "<u4")
    assert len(text) > 1 << 20 and got.tolist() == ids_of(library, line) * 60_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.integers(0, 700), st.integers(0, 300))
def test_blocks_round_trip(ids, start, n):
    raw = token_blocks.to_bytes(np.array(ids, np.uint32), np.zeros(0, token_blocks._DOCS))
    assert token_blocks.read_ids(raw, 0, len(ids)).tolist() == ids
    start = min(start, len(ids))
    assert token_blocks.read_ids(raw, start, n).tolist() == ids[start : start + n]


def expected(library, rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*ids_of(library, text or ""), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark, docs, library):
    rows = [(i * 7 - 20, t) for i, t in enumerate(ODD)] + [(900, None), (901, "last"), (902, "a b " * 3000)]
    shards = token_blocks.write_tokens(docs(rows[::-1]), WORD_TOKENIZER, 2, shard_ids=40)
    assert shards.count() > 3
    got = token_blocks.read_tokens(shards)
    assert sorted(tuple(r)[:4] for r in got.collect()) == expected(library, rows)
    assert [len(r.ids) // 4 for r in got.orderBy("doc_id").collect()] == [r[2] for r in expected(library, rows)]


def test_missing_and_repeated_ids(spark, docs, library):
    rows = [(None, "b"), (1, "same"), (1, "same"), (None, None), (0, "z")]
    got = token_blocks.read_tokens(token_blocks.write_tokens(docs(rows), WORD_TOKENIZER, 2), False).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 0, 1, 1]
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_empty_table(spark, docs):
    assert token_blocks.read_tokens(token_blocks.write_tokens(docs([]), WORD_TOKENIZER, 2)).collect() == []


def test_lost_attempts_leave_names_nobody_reads(tmp_path):
    names = {files.new_name(str(tmp_path), "x") for _ in range(3)}
    for name in names:
        with files.create(name) as out:
            out.write(b"abc")
    assert len(names) == 3 and {files.read_bytes(n) for n in names} == {b"abc"}
