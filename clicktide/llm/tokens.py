"""Token ids by the ``tokenizers`` library, with each distinct word encoded once.

The tokenizer this is made for normalises white space, lower-cases and splits
into runs of letters, single digits and runs of other characters before its
merges.  No step looks across a space, so the ids of a text are those of its
words in a row.  Words repeat, so the ids of words and of their runs are kept in
bounded caches of the worker.  The tokenizer's own special tokens are found in a
text as the library finds them: a word that holds one goes through the library.
"""

import re
from functools import lru_cache
from struct import Struct

from tokenizers import Tokenizer

from clicktide.llm.cache import Cache, hold

# Characters for which lower(), composition and the letter class are known to
# agree with the library's: printable ASCII and the Latin letters up to U+017F,
# without U+00D7 and U+00F7 (signs) and U+0130 (grows in lower case).
_LATIN = "À-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(f"[!-~{_LATIN}]+")
_STRETCH = 1 << 20
_RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z{_LATIN}0-9]+")
_PACKERS = [Struct(f"<{n}I").pack for n in range(32)]


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in kept}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else Struct(f"<{len(ids)}I").pack(*ids)


class WordEncoder:
    """Encodes texts as packed little-endian unsigned 32-bit ids.

    ``latin_runs`` allows the short way for plain words; it is right for
    tokenizers that lower-case and split as described above.  Without it every
    distinct word goes through the library's whole chain.
    """

    def __init__(self, path: str, latin_runs: bool = True, kept: int = 1 << 18):
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)").search
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or re.search(r"\s", t.content) for t in added):
            raise ValueError("special tokens that look at the text around them")
        self.tokenize = self.library.model.tokenize
        self.latin_runs = latin_runs
        self.characters = _byte_characters()
        self.runs = Cache(self._run, kept)
        self.words = Cache(self._word, kept)

    def _run(self, run):
        spelled = run if run.isascii() else "".join(map(self.characters.__getitem__, run.encode()))
        return _packed([t.id for t in self.tokenize(spelled)])

    def _word(self, word):
        # printable text without a space in it is what the pattern means by plain ASCII
        plain = word.isprintable() if word.isascii() else _PLAIN.fullmatch(word)
        if self.latin_runs and plain:
            if word.isalpha():
                return self.runs[word.lower()]
            if not self.special(word):
                return b"".join(map(self.runs.__getitem__, _RUNS.findall(word.lower())))
        return _packed(self.library.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if len(text) <= _STRETCH:
            return self._encode(text)
        parts, at = [], 0
        while at < len(text):  # a stretch at a time, cut at a space
            stop = text.find(" ", at + _STRETCH)
            stop = len(text) if stop < 0 else stop
            parts.append(self._encode(text[at:stop]))
            at = stop + 1
        return b"".join(parts)

    def _encode(self, text: str) -> bytes:
        spaced = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.words.__getitem__, spaced.split(" ")))


_made = lru_cache(maxsize=4)(WordEncoder)


def word_encoder(path: str, latin_runs: bool = True) -> WordEncoder:
    """One encoder a worker and file, kept between tasks."""
    encoder = _made(path, latin_runs)
    hold(encoder, encoder.runs, encoder.words)
    return encoder
