"""Words and their hashes for whole Arrow columns at once.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; A-Z count as a-z. The hash of a word of up to POLYNOMIAL
bytes is a polynomial over its bytes modulo 2**64, mixed; it is a difference of two running sums, so no word is looked at
by itself. Such polynomials have whole families of equal values among long strings (those of Thue and Morse, from 1,024
letters on), so a longer word has a BLAKE2b digest of 64 bits. A shingle's hash mixes the hashes of its words in order.
Two different words or shingles that nobody chose for it share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Text is taken in pieces of about this many bytes; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19
#: Longer ranges of bytes are hashed one by one.
POLYNOMIAL = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
#: For words of letters and digits only: every other ASCII byte ends a word.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse; those of a usual piece are kept."""
    if n > PIECE_BYTES:
        return _powers(n)
    return tuple(x[:n] for x in _usual_powers())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@cache
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(PIECE_BYTES)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of some rows after others; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_byte: np.ndarray | None = None) -> np.ndarray:
    """Hashes of ascending ranges of bytes; of_byte: what stands for each byte value. Ranges are taken in runs of about
    PIECE_BYTES, which bounds the memory at any length of text."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, "right")))
        part = data[starts[at] : ends[end - 1]]
        part = part if of_byte is None else of_byte[part]
        power, inverse = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        a, b = starts[at:end] - starts[at], ends[at:end] - starts[at]
        out[at:end] = (sums[b] - sums[a]) * inverse[a]
        at = end
    out = mix(out)
    for k in np.flatnonzero(ends - starts > POLYNOMIAL).tolist():
        whole = data[starts[k] : ends[k]]
        out[k] = int.from_bytes(blake2b(whole if of_byte is None else of_byte[whole], digest_size=8).digest(), "little")
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, and for each row the number of words before it (one more for the end).

    between: for each byte value, whether it stands between words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    edge = np.ones(len(data), bool)
    edge[1:] = ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    edge[rows] = True
    starts = np.flatnonzero(inside & edge)
    last = np.ones(len(data), bool)
    last[:-1] = ~inside[1:]
    last[rows[rows > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return range_hashes(data, starts, ends, _LOWER), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = mix(h * BASE + words[k : k + n])
    return h


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; a text of fewer words is one shingle, of none has none."""
    words, before = hashed_words(data, offsets)
    all_of = shingles(words, size)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(all_of[a : b - size + 1])
        elif b > a:
            yield shingles(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
