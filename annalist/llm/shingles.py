"""Word shingles of texts, hashed in bulk."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once.
SPAN = (1 << 21) - 4096
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n at least."""
    return _powers(1 << max(n, SPAN + 2).bit_length())


def blocks(texts: pa.Array, limit: int = SPAN) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `limit` bytes: index of the first, bytes, bounds of each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    sizes = pc.binary_length(texts).to_numpy()
    first, total = 0, 0
    for i, n in enumerate([*sizes.tolist(), None]):
        if n is None or (total and total + n > limit):
            if i > first:
                part = pa.concat_arrays([texts.slice(first, i - first)])
                bounds = np.append(0, np.cumsum(sizes[first:i])).astype(np.int64)
                begin = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset]
                data = np.frombuffer(part.buffers()[2], dtype=np.uint8)[begin : begin + bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8)
                yield first, data, bounds
            first, total = i, 0
        total += n or 0


#: Places of a word for which a table holds the numbers of all bytes; further ones are computed.
PLACES = 48


@lru_cache(maxsize=4)
def _numbers(key: int) -> np.ndarray:
    """A number for every byte at each of the first places of a word, drawn by the key."""
    return _number(np.arange(PLACES << 8, dtype=np.uint64), key)


def _number(place_and_byte: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(place_and_byte * BASE + np.uint64(key & (2**64 - 1))) ^ np.uint64((key * 0xD6E8FEB86659FD93 + 1) & (2**64 - 1)))


def word_hashes(data: np.ndarray, bounds: np.ndarray, key: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, lower-cased if asked, and how many words each text has.

    A word's hash is the sum of numbers drawn by `key` for each of its bytes at its place: two words
    collide with a chance of 2**-64, whatever they are, as long as the key is drawn behind them.
    """
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.append(False, inside[:-1]) if n else inside
    behind = np.append(inside[1:], False) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~behind | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    at <<= 8
    at |= _LOWER[data[inside]] if lower else data[inside]
    if int(sizes.max()) > PLACES:
        far = np.flatnonzero(at >= PLACES << 8)
        numbers = _numbers(key).take(at, mode="clip")
        numbers[far] = _number(at[far].astype(np.uint64), key)
    else:
        numbers = _numbers(key).take(at)
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat(numbers, firsts) + sizes.astype(np.uint64)), counts


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int, key: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; a text of fewer words has one for all of it."""
    words, counts = word_hashes(data, bounds, key)
    factors = [np.uint64(x | 1) for x in _number(np.arange(width, dtype=np.uint64), ~key)]
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for i, factor in enumerate(factors):
            rolled += words[i : i + len(rolled)] * factor
        rolled, at = mixed(rolled), 0
        for n in counts.tolist():
            if n >= width:
                yield np.unique(rolled[at : at + n - width + 1])
            elif n:
                short = sum((words[at + i : at + i + 1] * factors[i] for i in range(n)), np.full(1, n, dtype=np.uint64))
                yield mixed(short ^ np.uint64(0x5851F42D4C957F2D))
            else:
                yield np.zeros(0, dtype=np.uint64)
            at += n
