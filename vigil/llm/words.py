"""Vectorised words, word windows and their hashes over Arrow text arrays.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Word hashes are
sums of random byte values times powers of an odd number modulo 2**64, taken
from one running sum over the bytes and mixed; window hashes are built from
word hashes in the same way. Texts are worked in slices of about ``SLICE`` bytes
(a longer text is a slice of its own), which bounds the memory.
"""

from __future__ import annotations

from vigil.llm.common import cached

SLICE = 1 << 20
_ODD_BYTE, _ODD_WORD, _ODD_WORD2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F


def mix(x):
    """A bijective scrambling of uint64 arrays (the finaliser of splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(odd: int, n: int):
    """odd ** i and its inverse modulo 2**64, for i below n."""
    size = max(SLICE + 1, 1 << (n - 1).bit_length())
    if size > SLICE + 1:  # for a text beyond a slice; not kept
        return _make_powers(odd, n), _make_powers(pow(odd, -1, 1 << 64), n)
    return cached(("powers", odd), lambda: (_make_powers(odd, size), _make_powers(pow(odd, -1, 1 << 64), size)))


def _make_powers(odd: int, n: int):
    import numpy as np

    out = np.full(n, odd, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _byte_values(fold: bool):
    import numpy as np

    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD_WORD))
    if fold:
        t[65:91] = t[97:123]
    return t


class Words:
    """The words of some consecutive texts: byte spans (``start``, ``end``) in ``buf``; text k has the words
    ``first[k]`` to ``first[k + 1]``."""

    def __init__(self, buf, offsets, fold: bool):
        import numpy as np

        self.buf, self.offsets, self.fold = buf, offsets, fold
        sep = np.zeros(256, dtype=bool)
        sep[[9, 10, 11, 12, 13, 32]] = True
        inside = ~sep[buf]
        n = len(buf)
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = offsets[:-1][(offsets[:-1] < n)]
        new[at] = inside[at]
        at = offsets[1:][(offsets[1:] > 0)] - 1
        last[at] = inside[at]
        self.start, self.end = np.flatnonzero(new), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self):
        """One uint64 per word."""
        import numpy as np

        power, inverse = _powers(_ODD_BYTE, len(self.buf) + 1)
        run = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        np.cumsum(_byte_values(self.fold)[self.buf] * power[:len(self.buf)], dtype=np.uint64, out=run[1:])
        h = (run[self.end] - run[self.start]) * inverse[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))

    def windows(self, k: int, short: bool = False, second: bool = False):
        """(first word, text number, hash) of every window of ``k`` words inside one text, in text order. With
        ``short``, a text of fewer words, but not none, is one window. ``second`` adds an independent hash."""
        import numpy as np

        size = np.full(len(self.counts), k, dtype=np.int64)
        if short:
            size = np.where((self.counts > 0) & (self.counts < k), self.counts, size)
        n = np.maximum(self.counts - size + 1, 0)
        total, before = int(n.sum()), np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        at = np.repeat(self.first[:-1] - before, n) + np.arange(total)
        text = np.repeat(np.arange(len(n)), n)
        size = size[text]
        h = self.hashes()
        out = [at, text]
        for odd in (_ODD_WORD, _ODD_WORD2)[:1 + second]:
            power, inverse = _powers(odd, len(h) + 1)
            run = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(h * power[:len(h)], dtype=np.uint64, out=run[1:])
            out.append(mix((run[at + size] - run[at]) * inverse[at] + size.astype(np.uint64) * np.uint64(odd)))
            h = mix(h ^ np.uint64(_ODD_WORD2))
        return out


def slices(texts, fold: bool):
    """``Words`` of consecutive slices of an Arrow string array, with the number of each slice's first text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for chunk_at, arr in _chunks(texts):
        arr = pc.fill_null(arr, "").cast(pa.large_string())
        if len(arr) == 0:
            continue
        offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
        data = np.frombuffer(arr.buffers()[2] or b"", dtype=np.uint8)
        lo = 0
        while lo < len(arr):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE, side="right")) - 1)
            yield chunk_at + lo, Words(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], fold)
            lo = hi


def _chunks(texts):
    at = 0
    for arr in getattr(texts, "chunks", [texts]):
        yield at, arr
        at += len(arr)
