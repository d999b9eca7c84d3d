"""Word hashes of whole Arrow text columns, computed on their bytes with numpy.

A column of texts is one run of bytes with offsets.  Words are found by a table
of byte classes, and each word's hash is a difference of two prefix sums, so no
Python object is made for a word.  Hashes are equal exactly where the words'
bytes are equal, up to 64-bit collisions, and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RATIO = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes hashed at a time, apart from single texts that are longer.
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random-looking odd value for every byte.
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _powers(ratio: int, n: int) -> np.ndarray:
    """ratio**0, ratio**1, … modulo 2**64, n of them at least.

    A process keeps as many as a chunk needs; those of a longer text are made for it alone.
    """
    known = _POWERS.get(ratio)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), ratio, dtype=np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 4 * CHUNK_BYTES + 1:
            _POWERS[ratio] = known
    return known


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … for lengths[0] numbers, then those of starts[1], and so on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, ratio: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] for each i; equal runs have equal hashes wherever they stand."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(ratio, len(values))[: len(values)], out=sums[1:])
    back = _powers(pow(ratio, -1, 1 << 64), len(values) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _RATIO)


def white_space() -> np.ndarray:
    """Class of every byte for words that white space parts: 0 between words, 1 in a word."""
    classes = np.ones(256, dtype=bool)
    classes[[0x20, *range(0x09, 0x0E)]] = False
    return classes


def letters_and_digits() -> np.ndarray:
    """Class of every byte for words of letters and digits; all bytes beyond ASCII count as letters."""
    classes = np.zeros(256, dtype=bool)
    classes[0x80:] = True
    for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
        classes[lo : hi + 1] = True
    return classes


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters of UTF-8 bytes in lower case."""
    data = data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 0x20
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    data[after] += 0x20
    return data


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and where each text starts in them, with the end; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def find_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each text, with the total."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = classes[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True  # a text's end is a word's end
    starts_at, ends_at = inside.copy(), np.ones(len(data) + 1, dtype=bool)
    starts_at[1:] &= ~inside[:-1] | first[1:-1]
    ends_at[:-1] = ~inside | first[:-1]
    starts = np.flatnonzero(starts_at)
    ends_at[0] = False
    ends = np.flatnonzero(ends_at[1:] & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column, classes: np.ndarray, fold: bool = False, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The texts of a column in chunks of bounded bytes.

    Yields for each chunk: index of its first text, hash of every word, number of
    words before each text with the total, bytes before each text with the total,
    and (bytes, word starts, word ends).
    """
    data, offsets = texts(column)
    if fold and len(data):
        data = lower(data)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, side="right")) - 1)
        part, bounds = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        starts, ends, before = find_words(part, bounds, classes)
        hashes = run_hashes(_BYTE_VALUES[part], starts, ends, 0xDA942042E4DD58B5) if len(starts) else np.zeros(0, np.uint64)
        yield at, hashes, before, bounds, (part, starts, ends)
        at = to


def window_hashes(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words of one text, and the number of runs before each text, with the total."""
    counts = np.maximum(np.diff(before) - width + 1, 0)
    starts = ranges(before[:-1], counts)
    found = run_hashes(hashes, starts, starts + width) if len(starts) else np.zeros(0, np.uint64)
    return found, np.concatenate(([0], np.cumsum(counts)))
