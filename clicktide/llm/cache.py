"""A bounded cache for values that are worked out again and again in a worker."""

import ctypes
import gc

import pyarrow as pa

LONGEST_KEPT = 64

_holder: list = [None, ()]


def hold(owner, *caches: "Cache") -> None:
    """Let ``owner`` keep its caches between tasks; those of the owner before are emptied.

    A worker serves one operator after another, and needs the memory of one.
    """
    if _holder[0] is not owner:
        for cache in _holder[1]:
            cache.clear()
            cache.old = {}
        if _holder[0] is not None:
            give_back()
        _holder[:] = [owner, caches]


def give_back() -> None:
    """Return freed memory to the system, so that a worker's next operator has room for its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


class Cache(dict):
    """Computes what is missing and keeps it for keys of up to 64 characters.

    When full, the entries become the old ones and a new set begins; old entries
    that are asked for again move over.  At most twice ``size`` entries are held.
    """

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > LONGEST_KEPT:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
