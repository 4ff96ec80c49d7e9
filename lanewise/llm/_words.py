"""Vectorised words, word hashes and k-gram hashes over Arrow text columns.

A text is read as UTF-8 bytes. Both word classes in use are closed under this view: every byte
above 0x7F belongs to a word, and lower-casing A-Z touches single bytes only. Hashes have 64 bits
and depend on the bytes of a word alone, so they agree between tasks and between tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_RADIX = _U(0x9E3779B97F4A7C15 | 1)
_RADIX_INVERSE = _U(pow(int(_RADIX), -1, 1 << 64))
_GRAM = _U(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _RADIX)
_OTHER_VALUES = mix64(np.arange(1001, 1257, dtype=np.uint64) * _RADIX)


class WordClass:
    """Which bytes make words, and the hash value of each byte."""

    def __init__(self, is_word: np.ndarray, lower: bool):
        self.is_word = is_word
        folded = np.arange(256)
        if lower:
            folded[65:91] += 32
        self.values = _VALUES[folded]
        self.lower = lower


def _spaced() -> np.ndarray:
    mask = np.ones(256, dtype=bool)
    mask[[0x20, *range(0x09, 0x0E)]] = False
    return mask


def _alphanumeric() -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[0x30:0x3A] = mask[0x41:0x5B] = mask[0x61:0x7B] = mask[0x80:] = True
    return mask


#: Runs of anything but ASCII white space, unchanged.
SPACED = WordClass(_spaced(), lower=False)
#: The same, with A-Z taken as a-z.
SPACED_LOWER = WordClass(_spaced(), lower=True)
#: Runs of ASCII digits and letters and of everything beyond ASCII, with A-Z taken as a-z.
ALNUM_LOWER = WordClass(_alphanumeric(), lower=True)


@dataclass
class Block:
    """Some consecutive texts of a column, and their words."""

    first: int  # row of the first text
    buf: np.ndarray  # bytes of the texts, one after the other
    text_at: np.ndarray  # where each text starts in buf, and the end
    start: np.ndarray  # of each word, in buf
    end: np.ndarray
    word_at: np.ndarray  # where each text's words start, and the end
    hashes: np.ndarray  # of each word

    def __len__(self) -> int:
        return len(self.text_at) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.word_at))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse, of exponents up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        both = []
        for base in (_RADIX, _RADIX_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[:] = both
    return _powers[0], _powers[1]


def text_groups(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts of up to ``limit`` bytes together: first row, bytes, and where texts start."""
    if len(column) == 0:
        return
    raw, at = _buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(buf: np.ndarray, text_at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = is_word[buf]
    before = np.empty_like(mask)
    before[1:] = mask[:-1]
    inner = text_at[:-1][text_at[:-1] < len(buf)]
    before[inner] = False
    start = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[:-1] = mask[1:]
    ends = text_at[1:][text_at[1:] > 0]
    after[ends - 1] = False
    end = np.flatnonzero(mask & ~after) + 1
    return start, end


def span_hashes(words: WordClass, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    up, down = _tables(len(buf))
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    terms = words.values[buf]
    terms *= up[: len(buf)]
    np.cumsum(terms, out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def blocks(column: pa.Array, words: WordClass, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    for first, buf, text_at in text_groups(column, limit):
        start, end = word_spans(buf, text_at, words.is_word)
        yield Block(first, buf, text_at, start, end, np.searchsorted(start, text_at), span_hashes(words, buf, start, end))


def second_hashes(block: Block, chosen: np.ndarray | None = None) -> np.ndarray:
    """Another hash of each word (or of the chosen ones), from byte values of its own."""
    up, down = _tables(len(block.buf))
    if chosen is not None:
        start, length = block.start[chosen], block.end[chosen] - block.start[chosen]
        ends = np.cumsum(length)
        inside = np.arange(int(length.sum())) - np.repeat(ends - length, length)
        terms = _OTHER_VALUES[block.buf[inside + np.repeat(start, length)]] * up[inside]
        total = np.add.reduceat(terms, ends - length) if len(terms) else np.zeros(0, np.uint64)
        return mix64(total - length.astype(np.uint64))
    sums = np.empty(len(block.buf) + 1, dtype=np.uint64)
    sums[0] = 0
    terms = _OTHER_VALUES[block.buf]
    terms *= up[: len(block.buf)]
    np.cumsum(terms, out=sums[1:])
    return mix64((sums[block.end] - sums[block.start]) * down[block.start] - (block.end - block.start).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of k consecutive words from each word on; shorter by k - 1 than the input."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, (k * 0x2545F4914F6CDD1D + seed * 0x9E3779B97F4A7C15) & (2**64 - 1), dtype=np.uint64)
    for j in range(k):
        total *= _GRAM
        total += hashes[j : j + n]
    return mix64(total)


def gram_starts(word_at: np.ndarray, k: int) -> np.ndarray:
    """Mask over the k-grams of a block: true for those that lie in one text."""
    n = int(word_at[-1]) - k + 1
    mask = np.ones(max(n, 0), dtype=bool)
    if n > 0:
        for back in range(1, k):
            at = word_at[1:-1] - back
            mask[at[(at >= 0) & (at < n)]] = False
    return mask


def winnow(hashes: np.ndarray, window: int, valid: np.ndarray) -> np.ndarray:
    """Positions that hold the smallest hash of some ``window`` consecutive valid ones (the last, in ties)."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at, whole = hashes[:n].copy(), np.arange(n), valid[:n].copy()
    for j in range(1, window):
        other = hashes[j : j + n]
        less = other <= best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
        whole &= valid[j : j + n]
    return np.unique(at[whole])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
