"""Numpy helpers on the UTF-8 bytes of Arrow batches.

Strings are hashed by position sums modulo 2**64: with a 64-bit code c(b) for each byte value and
an odd base p, the span [s, e) has the hash (H[e] - H[s]) / p**s, H being the running sum of
c(b[i]) * p**i. One pass over the bytes gives the hash of every span.
"""

import numpy as np
import pyarrow as pa

# A task needs up to 100 bytes of memory for each of these.
CHUNK_BYTES = 1 << 18
U = np.uint64


def mix(x):
    """Bijective scrambling of 64-bit numbers (the public splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbers(seed, n):
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed * 1_000_003)) * U(0x9E3779B97F4A7C15))


def byte_codes(seed, fold_case=False):
    codes = numbers(seed, 256)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed):
        self.base = int(numbers(seed, 1)[0]) | 1
        self.up = self.down = np.ones(1, U)

    def upto(self, n):
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            self.up, self.down = (self._row(b, size) for b in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _row(base, n):
        row = np.full(n, base, U)
        row[0] = 1
        return np.multiply.accumulate(row)


class SpanHash:
    """Hashes of any spans of a byte array."""

    def __init__(self, codes, powers):
        self.codes, self.powers = codes, powers

    def read(self, data):
        up, self.down = self.powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(self.codes[data] * up[: len(data)], out=self.sums[1:])
        return self

    def of(self, start, end):
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def utf8(column):
    """Bytes and offsets of an Arrow string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * width).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, size=CHUNK_BYTES):
    """Cut a column into runs of whole texts of about `size` bytes: (first row, bytes, offsets)."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


# Bytes that part words when punctuation is dropped: white space, controls and ASCII signs.
SIGNS = np.ones(256, bool)
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_bounds(data, offsets, blanks=SPACE):
    """Start and end of every word, and the word range of every text: texts never join words."""
    blank = blanks[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = ~blank
    begins[1:] &= blank[:-1] | first[1:-1]
    ends = ~blank
    ends[:-1] &= blank[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)

