"""Vectorised hashes of byte strings that lie one after another in a flat array."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 3  # odd, so that its powers can be divided out
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LONG = 64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _table(base: int, n: int) -> np.ndarray:
    """The powers 0 to n of the base modulo 2**64, kept for later calls."""
    have = _powers[base]
    while len(have) <= n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: with them the hash of any stretch costs one subtraction and one product."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _table(_BASE, len(data))[:-1], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal hashes wherever they lie."""
    return mix((sums[end] - sums[start]) * _table(_INVERSE, len(sums) - 1)[start] + (end - start).astype(np.uint64))


def tokens(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], no polynomials: each eight bytes go through a bijection that depends on
    all bytes before; words beyond _LONG bytes take BLAKE2b."""
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(_BASE) + _CODES[0])
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    short = np.flatnonzero(size <= _LONG)
    for at in range(0, _LONG, 8):
        short = short[size[short] > at]
        if not len(short):
            break
        lane = np.ascontiguousarray(eights[start[short] + at]).view("<u8")[:, 0] & _KEEP[np.minimum(size[short] - at, 8)]
        out[short] = mix((out[short] ^ lane) * np.uint64(_BASE) + _CODES[1])
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]], digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row): maximal runs of word bytes that end where a row ends.

    is_word has a truth value for each byte value; the last array has n + 1 word offsets.
    """
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    step = np.diff(inside)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]) if len(cut) else cut
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, offsets)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of the two kinds of words: everything but white space; letters, digits and non-ASCII.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
