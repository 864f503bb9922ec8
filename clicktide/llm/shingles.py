"""Sets of word shingles as arrays of 64-bit hashes, worked out for many texts at once."""

import numpy as np

_RANDOM = np.random.default_rng(20240517)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CHUNK = 2 << 20  # bytes hashed at once


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(256, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _FACTOR, np.uint64))])
    return _POWERS


def _word_hashes(data: np.ndarray):
    """Hash and end of each word of a byte array that ends in white space, a stretch at a time."""
    hashes, ends, at = [], [], 0
    while at < len(data):
        stop = min(at + 2 * _CHUNK, len(data))
        while not _SPACE[data[stop - 1]]:  # on to the end of the word
            later = np.flatnonzero(_SPACE[data[stop : stop + _CHUNK]])
            stop += int(later[0]) + 1 if len(later) else min(_CHUNK, len(data) - stop)
        found, upto = _stretch_hashes(data[at:stop])
        hashes.append(found)
        ends.append(upto + at)
        at = stop
    return np.concatenate(hashes), np.concatenate(ends)


def _stretch_hashes(data: np.ndarray):
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), ends
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes  # of each word among the bytes of words
    place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    with np.errstate(over="ignore"):
        values = _BYTE[data[inside]] * _powers(int(sizes.max()))[place]
        return mix(np.add.reduceat(values, firsts)), ends


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A-Z count as lower case, words are runs of characters other than ASCII white
    space.  A text of fewer than ``width`` words has one shingle, its whole word
    sequence; one without words has none.
    """
    out: list[np.ndarray] = []
    chunk, size = [], 0
    for text in texts:
        raw = text.encode().lower()  # of bytes: A-Z alone
        chunk.append(raw)
        size += len(raw) + 1
        if size >= _CHUNK:
            out += _chunk_sets(chunk, width)
            chunk, size = [], 0
    return out + _chunk_sets(chunk, width)


def _chunk_sets(chunk: list[bytes], width: int) -> list[np.ndarray]:
    if not chunk:
        return []
    data = np.frombuffer(b" ".join(chunk) + b" ", np.uint8)
    words, ends = _word_hashes(data)
    bounds = np.cumsum([len(raw) + 1 for raw in chunk])
    upto = np.searchsorted(ends, bounds, side="left")
    out, first = [], 0
    n = len(words)
    with np.errstate(over="ignore"):
        if n >= width:
            rolled = words[: n - width + 1] * _PLACE[0]
            for k in range(1, width):
                rolled += words[k : n - width + 1 + k] * _PLACE[k]
            rolled = mix(rolled)
        for last in upto:
            count = last - first
            if count >= width:
                out.append(np.unique(rolled[first : last - width + 1]))
            elif count:
                short = (words[first:last] * _PLACE[:count]).sum() + np.uint64(count) * _FACTOR
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
            first = last
    return out


def set_signature(shingles: np.ndarray) -> bytes:
    """192 bits that equal sets share."""
    with np.errstate(over="ignore"):
        sums = [int(mix(shingles + np.uint64(k)).sum(dtype=np.uint64)) for k in (1, 2)]
    return np.array([len(shingles), *sums], "<u8").tobytes()


# --- distances to hash classes ----------------------------------------------


def class_counts(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of 2**k hash classes, about two a class, at most 255."""
    n = len(shingles)
    classes = 1 << max(3, ((n + 1) // 2 - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return np.minimum(counts, 255).astype(np.uint8)


def fold(counts: np.ndarray, classes: int) -> np.ndarray:
    """Counts of coarser classes (as 32-bit integers), along the last axis."""
    wide = counts.astype(np.int32)
    while wide.shape[-1] > classes:
        half = wide.shape[-1] // 2
        wide = wide[..., :half] + wide[..., half:]
    return wide


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of shingles that are in one set only."""
    classes = min(len(a), len(b))
    return int(np.abs(fold(a, classes) - fold(b, classes)).sum())


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
