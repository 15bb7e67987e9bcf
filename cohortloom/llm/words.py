"""Words of whole texts as numpy arrays: one pass over the UTF-8 bytes of an Arrow batch.

Nothing here makes a Python object per word. A batch is worked on in slices of whole texts of
about ``SLICE`` bytes, so memory follows the longest text and not the batch.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
GATHER = 4 << 20  # text bytes whose results leave a task together
U = np.uint64


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    keep = np.zeros(256, bool)
    for low, high in ranges:
        keep[low : high + 1] = True
    return keep


# [^\x20\x09-\x0D]+
SPACED = ~byte_table((0x20, 0x20), (0x09, 0x0D))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text; bytes of 0x80 and above belong to non-ASCII characters
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words(NamedTuple):
    data: np.ndarray  # bytes of the slice, lower-cased if asked for
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    first: np.ndarray  # number of the first word of each text, and the number of words
    hashes: np.ndarray  # 64 bits per word


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they are needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


class Tokenizer:
    """Splits and hashes; one per task, since it keeps its tables."""

    def __init__(self, keep: np.ndarray, lower: bool):
        self.keep, self.lower = keep, lower
        self.letters = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.byte_powers = Powers(0x9E3779B97F4A7C15)
        self.word_powers = Powers(0xD1342543DE82EF95)

    def split(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; ``offsets`` begins with 0."""
        if self.lower:
            data = LOWER[data]
        n = len(data)
        inside = self.keep[data]
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        before[offsets] = False
        starts = np.flatnonzero(inside & ~before[:n])
        after[offsets] = False
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        up, down = self.byte_powers.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[data] * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)

    def rolling(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Rabin-Karp hashes of every n consecutive words, also across texts: the caller keeps
        those that lie inside one."""
        count = len(hashes) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        up, down = self.word_powers.upto(len(hashes))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up, out=sums[1:])
        return mix((sums[n:] - sums[:count]) * down[:count] + U(n))


def inside_text(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which a window of n words of one text starts, and their text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    skipped = np.cumsum(counts) - counts
    return np.arange(len(text)) + np.repeat(first[:-1] - skipped, counts), text


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column, limit: int = SLICE):
    """(first row, end row, bytes, offsets from 0) of consecutive whole texts of about ``limit`` bytes."""
    data, offsets = string_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def gathered(column, limit: int = GATHER):
    """Lists of consecutive slices that have about ``limit`` bytes together."""
    part, size = [], 0
    for piece in slices(column):
        part.append(piece)
        size += len(piece[2])
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def numbers(column, kind=np.int64) -> np.ndarray:
    """A numeric Arrow column as numpy; null is 0."""
    if column.null_count:
        column = column.fill_null(0)
    return column.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def binary_slices(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of ``values[bounds[i]:bounds[i + 1]]``."""
    raw = np.ascontiguousarray(values)
    offsets = (bounds * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def bounds_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the length."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def sent(kind: type, fields: dict):
    """The object of a class of this package whose fields were broadcast. Broadcasts hold plain
    values, since they don't carry classes along as functions do."""
    out = kind.__new__(kind)
    out.__dict__.update(fields)
    return out
