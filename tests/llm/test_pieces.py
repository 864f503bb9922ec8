import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from clicktide.llm import pieces
from clicktide.llm.queries import PIECE_TOKENIZER

ODD = [
    "", " ", "   ", "a  b", " a", "a ", "▁a x▁▁y", "\n\n\t a\r\nb", "ﬁ①Ａ", "é é", "<s></s><unk><0x0A>", "\x00", "日本 😀",
    "The cat isn't 12.50,", "x" * 3000, "aaaaaaa " * 500, "ьюяḀ​　z", ", . ,.  ..", "1234567890 1 22",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_TOKENIZER)


def test_ids_are_the_library_s(library):
    for text in ODD:
        assert pieces.piece_encoder(PIECE_TOKENIZER).encode(text) == library.encode(text), text


def test_long_texts_by_stretches(library, monkeypatch):
    monkeypatch.setattr(pieces, "_STRETCH", 5)
    for text in ODD + ["one  two▁ three\nfour " * 30]:
        assert pieces.piece_encoder(PIECE_TOKENIZER).encode(text) == library.encode(text), text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab ▁et\n.,hnin1s"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    encoder = pieces.piece_encoder(PIECE_TOKENIZER)
    assert encoder.encode(text) == encoder.library.encode(text)


def test_table(spark, docs, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (50, None), (51, "same"), (51, "same")]
    got = pieces.encode_pieces(docs(rows), PIECE_TOKENIZER).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_eos=True)
        joined = " ".join(map(str, ids))
        want.append((doc_id, len(ids), hashlib.sha256(joined.encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids, library.decode(ids)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table(spark, docs):
    assert pieces.encode_pieces(docs([]), PIECE_TOKENIZER).collect() == []
