"""Hashes of all words of an Arrow text column, as numpy arrays.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. Hashes are
polynomials over bytes modulo 2**64: prefix sums over a block give the hash of
every word in it without a loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_PUNCTUATION = np.zeros(256, bool)
IS_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

_BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < size:
        made = []
        for base in (_BASE, _BASE_INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            made.append(np.multiply.accumulate(factors))
        _powers = made[0], made[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bitmap(hashes: np.ndarray, bits: int) -> bytes:
    """``bits`` bits, those set that an element is hashed to."""
    found = np.zeros(bits, bool)
    found[(mix(hashes) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(found).tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each text; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts in order. ``text`` is the row each belongs to."""

    hash: np.ndarray
    text: np.ndarray
    #: Position of the first kept byte in the bytes of all texts.
    start: np.ndarray
    #: Position after the last kept byte.
    end: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)

    def bounds(self, n_texts: int) -> np.ndarray:
        """Word number at which each text starts, and the total at the end."""
        return np.searchsorted(self.text, np.arange(n_texts + 1))


def words_of(data: np.ndarray, offsets: np.ndarray, drop: np.ndarray | None = None, lower: bool = True) -> Words:
    """All words. ``drop`` marks bytes that are left out of words.

    A word of left-out bytes only is none.
    """
    parts = []
    position, size = 0, len(data)
    text_starts = offsets[:-1]
    while position < size:
        end = min(size, position + _BLOCK)
        if end < size:
            back = np.flatnonzero(IS_SPACE[data[position:end]])
            if len(back):
                end = position + int(back[-1]) + 1
            else:  # one very long word
                while end < size and not IS_SPACE[data[end]]:
                    end = min(size, end + _BLOCK)
                    found = np.flatnonzero(IS_SPACE[data[position:end]])
                    if len(found):
                        end = position + int(found[0]) + 1
                        break
        parts.append(_block(data, position, end, offsets, text_starts, drop, lower))
        position = end
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    return Words(*(np.concatenate([p[k] for p in parts]) for k in range(4)))


def _block(data, begin, end, offsets, text_starts, drop, lower):
    raw = data[begin:end]
    first = np.zeros(len(raw) + 1, bool)  # a text starts before this byte
    inside = text_starts[(text_starts >= begin) & (text_starts < end)] - begin
    first[inside] = True
    if drop is not None:
        keep = ~drop[raw]
        at = np.flatnonzero(keep)
        # A text may start at a left-out byte: the mark moves to the next kept one.
        marks = np.searchsorted(at, inside)
        raw = raw[at]
        first = np.zeros(len(raw) + 1, bool)
        first[marks] = True
    else:
        at = None
    wordy = ~IS_SPACE[raw]
    before = np.empty_like(wordy)
    before[:1] = False
    before[1:] = wordy[:-1]
    starts = np.flatnonzero(wordy & (~before | first[:-1]))
    after = np.empty_like(wordy)
    after[-1:] = False
    after[:-1] = wordy[1:]
    ends = np.flatnonzero(wordy & (~after | first[1:])) + 1
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[LOWER[raw] if lower else raw] * power[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    if at is None:
        raw_starts, raw_ends = starts + begin, ends + begin
    else:
        raw_starts, raw_ends = at[starts] + begin, at[ends - 1] + 1 + begin
    text = np.searchsorted(offsets, raw_starts, side="right") - 1
    return hashes, text, raw_starts, raw_ends


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one text, and its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(words.text[:n] == words.text[size - 1 :])
    value = np.zeros(len(whole), np.uint64)
    for k in range(size):
        value = mix(value * _BASE + words.hash[whole + k])
    return value, whole
