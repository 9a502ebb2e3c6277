"""Vectorised helpers on Arrow text batches, used inside Spark tasks.

Texts are looked at as UTF-8 bytes in pieces of about a megabyte that never
split a document, so what a task holds is bounded by the longest document.
Hashes are polynomials modulo 2**64 over a running sum, finished with a 64-bit
mixer; callers that need certainty carry two of them or compare the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xD1B54A32D192ED03
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that every bit of a hash can be used."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Hashes of spans of a sequence: ``prefix`` once, then ``span`` for any bounds."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            for name, by in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, by, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:], dtype=U64)
        return out

    def span(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[begin]) * self.down[begin])


def byte_values(seed: int = 1) -> np.ndarray:
    """A random odd number for each byte."""
    return mix(np.arange(256, dtype=U64) * U64(2) + U64(seed * 1000 + 1)) | U64(1)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of anything but space and U+0009 to U+000D.
BLANK_WORDS = ~SPACE
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM_WORDS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)


def pieces(text: pa.Array, limit: int = PIECE_BYTES):
    """Yields (first row, rows, bytes, offsets); a null text is an empty one."""
    if pa.types.is_string(text.type):
        text = text.cast(pa.large_string())
    n = len(text)
    if not n:
        return
    _, where, held = text.buffers()
    off = np.frombuffer(where, np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    if text.null_count:  # a null may stand over bytes
        size = np.where(np.asarray(text.is_valid()), np.diff(off), 0)
        if (size != np.diff(off)).any():
            yield from pieces(text.fill_null(""), limit)
            return
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, last - row, data[off[row] : off[last]], off[row : last + 1] - off[row]
        row = last


def words(data: np.ndarray, off: np.ndarray, in_word: np.ndarray):
    """(starts, ends, offsets of each row's words) of the words of a piece."""
    m = in_word[data]
    if not m.any():
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    head = m.copy()
    head[1:] &= ~m[:-1]
    tail = m.copy()
    tail[:-1] &= ~m[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]  # a row's end ends a word
    head[edge] = m[edge]
    tail[edge - 1] = m[edge - 1]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1, np.searchsorted(starts, off)


def run_bounds(sorted_values: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, and the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, len(sorted_values)]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in [s, s + width) of any start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def lists(values: np.ndarray, off: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))


def blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes without the empty high ones."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    used = max([1, *(k + 1 for k in range(8) if planes[k].any())])
    return bytes([used]) + planes[:used].tobytes()


def unpack(held: bytes) -> np.ndarray:
    used = held[0]
    planes = np.frombuffer(held, np.uint8, offset=1).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u8").ravel()


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the 64-bit keys each one falls in."""
    return ((keys >> U64(32)) * U64(n)) >> U64(32)


def by_bucket(keys: np.ndarray, n: int):
    """(order, pairs of bucket and slice): rows in the order of their buckets, stable within one."""
    b = bucket_of(keys, n)
    order = np.argsort(b, kind="stable")
    bounds = run_bounds(b[order])
    return order, [(int(b[order[lo]]), slice(lo, hi)) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if hi > lo]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which rows have a key that another row has too. keys: one column, or rows of several."""
    if keys.ndim == 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
    else:
        order = np.lexsort(keys.T)
        k = keys[order]
        same = (k[1:] == k[:-1]).all(1)
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def grouped_rows(ids: np.ndarray, *values: np.ndarray):
    """Values gathered by id (rows of t1, t2): (ids, offsets, values in that order)."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    k = ids[order]
    new = np.r_[True, (k[1:] != k[:-1]).any(1)] if len(k) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return k[first], np.r_[first, len(k)], [v[order] for v in values]
