"""Hashes of the words of whole Arrow columns of texts, by numpy over their bytes.

A word is a run of bytes other than the six ASCII white-space characters; A-Z count as a-z. Its hash is the sum of a random
64-bit number for each byte times a power of an odd base by the byte's place in the word, mixed. Sums over all words of a block
of bytes are one ``reduceat``; powers are those of the place in the block, divided by the power of the word's start.

Edge cases: null and blank texts have no words; words never span two texts; texts and words of any length are cut
into blocks of BLOCK bytes, so memory stays bounded by the column itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_OVER = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words without visible pattern."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _letters() -> np.ndarray:
    out = mix(np.arange(1, 257, dtype=_U) * _U(_BASE)) | _U(1)
    out[65:91] = out[97:123]
    out[_SPACE] = 0
    return out


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_LETTERS, _UP, _DOWN = _letters(), _powers(_BASE), _powers(_OVER)


def _long_word(data: np.ndarray) -> np.uint64:
    """The sum of a word that doesn't fit a block."""
    total = 0
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        total += int((_LETTERS[part] * _UP[: len(part)]).sum(dtype=_U)) * pow(_BASE, at, 1 << 64)
    return _U(total & (1 << 64) - 1)


def _block_end(data: np.ndarray, at: int, cuts: np.ndarray) -> tuple[int, bool]:
    """Where a block that starts at ``at`` ends, at no place inside a word; and whether it is one long word."""
    end = at + BLOCK
    if end >= len(data):
        return len(data), False
    spaces = np.flatnonzero(_SPACE[data[at:end]])
    cut = int(cuts[np.searchsorted(cuts, end, "right") - 1])
    best = max(cut, at + int(spaces[-1]) + 1 if len(spaces) else 0)
    if best > at:
        return best, False
    stop = int(cuts[np.searchsorted(cuts, at, "right")])
    for look in range(end, stop, BLOCK):
        spaces = np.flatnonzero(_SPACE[data[look : min(look + BLOCK, stop)]])
        if len(spaces):
            return look + int(spaces[0]), True
    return stop, True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and the places where each text's begin (one more than texts)."""
    texts = texts.fill_null("")
    n = len(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if n == 0 or texts.buffers()[2] is None:
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    cuts = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    hashes, starts, at = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end, one = _block_end(data, at, cuts)
        part = data[at:end]
        if one:
            hashes.append(np.array([_long_word(part)], _U))
            starts.append(np.array([at], np.int64))
        else:
            word = ~_SPACE[part]
            first = word.copy()
            first[1:] &= ~word[:-1]
            inside = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, end)] - at
            first[inside] = word[inside]
            s = np.flatnonzero(first)
            if len(s):
                hashes.append(np.add.reduceat(_LETTERS[part] * _UP[: len(part)], s) * _DOWN[s])
                starts.append(s + at)
        at = end
    return mix(np.concatenate(hashes)), np.searchsorted(np.concatenate(starts), cuts)
