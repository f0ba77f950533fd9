"""Words of Arrow string columns as arrays, without a Python loop over words.

All texts of a batch lie in one buffer of UTF-8 bytes. A table of 256 flags says which bytes belong to words; since
every byte of a non-ASCII character is above 127, a class of ASCII separators is exact on bytes.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Everything but U+0020 and U+0009 to U+000D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ASCII letters and digits, and all bytes of other characters.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_lo : _hi + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of all texts: 64-bit hashes, byte ranges in ``data``, and the range of words of each text."""

    data: np.ndarray
    text_starts: np.ndarray  # of n + 1: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of n + 1: words

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text starts (n + 1 numbers, from 0)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, member: np.ndarray = NOT_BLANK, lower: bool = True) -> Words:
    """All maximal runs of member bytes inside each text, ASCII letters lower-cased."""
    data, text_starts = bytes_of(texts)
    if lower:
        data = LOWER[data]
    inside = member[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = True, ~inside
    edge = text_starts[:-1][np.diff(text_starts) > 0]
    before[edge] = True  # a word ends with its text
    starts = np.flatnonzero(inside & before[:-1])
    after = np.ones(len(data), bool)
    after[:-1] = ~inside[1:]
    after[edge[1:] - 1] = True
    ends = np.flatnonzero(inside & after) + 1
    hashes = np.empty(len(starts), np.uint64)
    cut = 0
    while cut < len(starts):
        stop = max(cut + 1, int(np.searchsorted(starts, starts[cut] + BLOCK)))
        hashes[cut:stop] = _hashed(data, starts[cut:stop], ends[cut:stop])
        cut = stop
    return Words(data, text_starts, hashes, starts, ends, np.searchsorted(starts, text_starts))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of byte ranges that lie close together, mixed with their lengths."""
    lengths = ends - starts
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(lengths.max()), MULTIPLIER))))
    values = (data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64))


def filled(column: pa.Array) -> pa.Array:
    """The column with nulls as empty texts."""
    return column.fill_null("")
