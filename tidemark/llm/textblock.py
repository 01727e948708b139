"""Vectorised text work on the UTF-8 bytes of an Arrow string column: words, hashes and counts by document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_Q = U64(pow(int(_P), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}
#: Powers that a process keeps, 8 MB of each kind at most; a longer text's are made for it alone.
KEPT_POWERS = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and everything outside ASCII, once A-Z are lower case.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length()) if n <= KEPT_POWERS else n
        p, q = np.full(size, _P, U64), np.full(size, _Q, U64)
        p[0] = q[0] = 1
        p, q = np.multiply.accumulate(p, out=p), np.multiply.accumulate(q, out=q)
        if n > KEPT_POWERS:
            return p, q
        _POWERS["p"], _POWERS["q"] = p, q
    return _POWERS["p"], _POWERS["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of h."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class TextBlock:
    """The texts of one step. ``buf``: their bytes, end to end; ``offs``: where each begins. Null counts as empty."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        self.n = len(texts)
        if self.n:
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + self.n + 1]
            data = texts.buffers()[2]
            whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            self.buf, self.offs = whole[offsets[0] : offsets[-1]], offsets - offsets[0]
        else:
            self.buf, self.offs = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        if lower:
            self.buf = LOWER[self.buf]
        self._pre = None

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes of the kind ``inside`` (a 256 table); none crosses a text. Starts, ends, text numbers."""
        if not len(self.buf):
            z = np.zeros(0, np.int64)
            return z, z, z
        m = inside[self.buf]
        first = np.zeros(len(m) + 1, bool)
        first[self.offs] = True  # the end counts too
        begins = m.copy()
        begins[1:] &= ~m[:-1] | first[1:-1]
        starts = np.flatnonzero(begins)
        ends_at = m.copy()
        ends_at[:-1] &= ~m[1:] | first[1:-1]
        return starts, np.flatnonzero(ends_at) + 1, self.doc_at(starts)

    def doc_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, places, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes of each span, whatever their place."""
        if not len(starts):
            return np.zeros(0, U64)
        p, q = _powers(len(self.buf) + 1)
        if self._pre is None:
            self._pre = np.zeros(len(self.buf) + 1, U64)
            np.cumsum(_BYTE[self.buf] * p[: len(self.buf)], out=self._pre[1:])
        return mix((self._pre[ends] - self._pre[starts]) * q[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def counts(self, marked: np.ndarray) -> np.ndarray:
        """By text, how many bytes a boolean mask over ``buf`` marks."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(marked, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def chars(self) -> np.ndarray:
        """Mask of the bytes that begin a code point."""
        return (self.buf & 0xC0) != 0x80

    def span_bytes(self, start: int, end: int) -> bytes:
        return self.buf[start:end].tobytes()


def windows(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` consecutive items of one document, and the place where each begins."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * _P + h[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(out[at]), at


def group_ids(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers equal hashes alike: the number of each item and the distinct hashes."""
    import pandas as pd

    codes, distinct = pd.factorize(h)
    return codes, distinct


def by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by document number, exact for integers."""
    return np.bincount(doc, weights=values, minlength=n)[:n]
