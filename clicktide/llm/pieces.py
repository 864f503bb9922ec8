"""SentencePiece encoding of merge-type vocabularies, and decoding.

A text is escaped as the library does (a leading mark, spaces as marks).  All
adjacent pairs of symbols that form a piece wait in an agenda ordered by score,
then by place; the best is merged and its new neighbours are entered, until none
is left.  Symbols outside the vocabulary become their bytes.

Two neighbouring characters that stand side by side in no piece can never be
merged, so a text falls apart at such places.  The parts between them repeat,
and their ids are kept in bounded caches of the worker.

In every Arrow batch, documents are encoded by the library as well and compared.
"""

import hashlib
import re
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from clicktide.llm.cache import Cache, hold
from clicktide.llm.common import documents

MARK = "▁"
_STRETCH = 1 << 20
_WORD_START = re.compile(f"(?<!{MARK}){MARK}")


class PieceEncoder:
    """Encodes with the pieces and scores of a model file.

    Only models of the merge type whose normaliser changes nothing but spaces
    are taken; others raise a ValueError.
    """

    def __init__(self, path: str, kept: int = 1 << 18):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        _require_plain_merges(path)
        library = self.library
        ordinary = [
            i for i in range(library.get_piece_size())
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))
        ]
        self.ids = {library.id_to_piece(i): i for i in ordinary}
        self.order = {library.id_to_piece(i): -library.get_score(i) for i in ordinary}  # the best first
        self.decimal = [str(i) for i in range(library.get_piece_size())]
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not library.is_byte(i) for i in self.bytes):
            raise ValueError("the model has no byte pieces")
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # words, if no piece goes on after a mark within it or spans a line end
        bound = any(pair[1] == MARK != pair[0] for pair in self.neighbours)
        lines = any("\n" in pair for pair in self.neighbours)
        self.words = None if bound or lines else re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall
        self.parts = Cache(self._agenda, kept)
        self.found = Cache(self._word, kept)

    def _agenda(self, part: str) -> tuple[int, ...]:
        """Merges the best pair until none is left; a pair that has changed since is skipped."""
        symbols = list(part)
        order, n = self.order.get, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (rank := order(pair)) is not None:
                agenda.append((rank, i, i + 1, pair))
        heapify(agenda)
        while agenda:
            _, left, right, pair = heappop(agenda)
            if after[left] != right or not symbols[left] or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            far = after[left] = after[right]
            if far < n:
                before[far] = left
                wider = pair + symbols[far]
                if (rank := order(wider)) is not None:
                    heappush(agenda, (rank, left, far, wider))
            near = before[left]
            if near >= 0:
                wider = symbols[near] + pair
                if (rank := order(wider)) is not None:
                    heappush(agenda, (rank, near, left, wider))
        out = []
        for symbol in symbols:
            if symbol:
                known = self.ids.get(symbol)
                out.extend([known] if known is not None else [self.bytes[b] for b in symbol.encode()])
        return tuple(out)

    def _word(self, word: str) -> tuple[int, ...]:
        neighbours, begin, out = self.neighbours, 0, []
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in neighbours:
                out.append(self.parts[word[begin:i]])
                begin = i
        if not begin:
            return self.parts[word]
        out.append(self.parts[word[begin:]])
        return tuple(chain.from_iterable(out))

    def split(self, escaped: str) -> list[str]:
        return self.words(escaped) if self.words else [escaped]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        escaped = MARK + text.replace(" ", MARK)
        if len(escaped) <= _STRETCH or not self.words:
            return list(chain.from_iterable(map(self.found.__getitem__, self.split(escaped))))
        out, at = [], 0
        while at < len(escaped):  # a stretch at a time, cut before a word
            found = _WORD_START.search(escaped, at + _STRETCH)
            stop = found.start() if found else len(escaped)
            out.extend(chain.from_iterable(map(self.found.__getitem__, self.split(escaped[at:stop]))))
            at = stop
        return out


def _require_plain_merges(path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    trained, normal = model.trainer_spec, model.normalizer_spec
    plain = (
        trained.model_type == trained.BPE
        and not trained.treat_whitespace_as_suffix
        and not normal.precompiled_charsmap
        and normal.add_dummy_prefix
        and not normal.remove_extra_whitespaces
        and not any(p.type == p.USER_DEFINED for p in model.pieces)
    )
    if not plain:
        raise ValueError("not a merge-type model without text normalisation")


_made = lru_cache(maxsize=4)(PieceEncoder)


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder a worker and file, kept between tasks."""
    encoder = _made(path)
    hold(encoder, encoder.parts, encoder.found)
    return encoder


def encode_pieces(
    docs: DataFrame, model: str, outputs: bool = True, check_every: int = 64
) -> DataFrame:
    """Encode every text with an end id, and decode the ids again.

    Returns a row per row of ``docs`` (of which only ``doc_id`` and ``text`` are
    read): ``doc_id, n_tokens``, the SHA-256 of the decimal ids joined by spaces
    and of the decoded text, and with ``outputs`` also ``ids`` and ``decoded``.
    A null text counts as empty and has the end id alone; a null id stays null;
    repeated rows are kept.  Nothing is shuffled.

    ``check_every``: in each batch the first and every so-manieth document is
    compared with the library; a difference raises an error.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if outputs:
        schema += ", ids array<int>, decoded string"
    return documents(docs).mapInArrow(
        partial(_encode_batches, model=model, outputs=outputs, check_every=check_every), schema
    )


def _encode_batches(batches, model, outputs, check_every):
    encoder = piece_encoder(model)
    end = encoder.library.eos_id()
    for batch in batches:
        texts = batch.column("text")
        counts, id_hashes, text_hashes, ids_out, texts_out = [], [], [], [], []
        for row in range(len(texts)):
            text = texts[row].as_py()
            ids = encoder.encode(text)
            ids.append(end)
            if row % check_every == 0 and ids != encoder.library.encode(text, add_eos=True, num_threads=1):
                raise AssertionError(f"the library encodes doc_id {batch.column('doc_id')[row]} otherwise")
            spelled = " ".join(map(encoder.decimal.__getitem__, ids))
            decoded = encoder.library.decode(ids)
            counts.append(len(ids))
            id_hashes.append(hashlib.sha256(spelled.encode()).hexdigest())
            text_hashes.append(hashlib.sha256(decoded.encode()).hexdigest())
            if outputs:
                ids_out.append(ids)
                texts_out.append(decoded)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()),
                   pa.array(text_hashes, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if outputs:
            columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts_out, pa.string())]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names=names)
