"""Words of texts as 64-bit codes, many texts at a time.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; these separators are ASCII, so
UTF-8 bytes and code points give the same words. Codes are computed for a whole buffer with
NumPy, a bounded piece of it at a time, so that a very long text needs no more than its own
bytes, eight bytes a word and one piece's working memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 16  # bytes worked on at a time: what their codes need stays in a core's cache
HELD = 1 << 20  # bytes of texts coded together
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache
def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of value * base**position, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, _room(len(values)))[: len(values)], out=out[1:])
    return out


def _room(n: int) -> int:
    """Length up to which powers are kept: few different ones, so that they are reused."""
    return max(PIECE + 1, 1 << (n - 1).bit_length()) if n > 1 else PIECE + 1


def _shifted(total: np.ndarray, start: np.ndarray, base: int, room: int) -> np.ndarray:
    """A sum that began at ``start`` as if it had begun at zero."""
    return total * powers(_inverse(base), room)[start]


def _piece_codes(piece: np.ndarray, gap: np.ndarray, heads: tuple[int, ...],
                 ) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of the words (and of their heads) of a buffer that begins and ends between words."""
    inside = np.zeros(len(piece) + 2, np.int8)
    inside[1:-1] = ~gap[piece]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = [np.zeros(len(start), np.uint64) for _ in range(1 + len(heads))]
    wide, room = piece.astype(np.uint64) + np.uint64(1), _room(len(piece))
    stops = [end] + [np.minimum(end, start + n) for n in heads]
    for base in _BASES:
        sums = _sums(wide, base)
        for i, stop in enumerate(stops):
            out[i] = mixed(out[i] + _shifted(sums[stop] - sums[start], start, base, room))
    return out, start


def codes_in(buffer: np.ndarray, lower: bool = False, gap: np.ndarray = _SPACE,
             heads: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of all words, then of their first n bytes for each of ``heads``; start offsets.

    ``gap`` marks the bytes between words.
    """
    codes: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(1 + len(heads))]
    starts, at = [np.zeros(0, np.int64)], 0
    while at < len(buffer):
        stop = min(len(buffer), at + PIECE)
        while stop < len(buffer) and not gap[buffer[stop]]:
            ahead = np.flatnonzero(gap[buffer[stop: stop + 4096]])
            stop = stop + int(ahead[0]) if len(ahead) else min(len(buffer), stop + 4096)
        piece = buffer[at:stop]
        found, start = _piece_codes(_LOWER[piece] if lower else piece, gap, heads)
        for own, new in zip(codes, found, strict=True):
            own.append(new)
        starts.append(start + at)
        at = stop
    return [np.concatenate(own) for own in codes], np.concatenate(starts)


def word_codes(buffer: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of a byte buffer and the offsets at which they start."""
    (codes,), starts = codes_in(buffer, lower)
    return codes, starts


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of all runs of n neighbouring words; fewer words than n give none."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    base, room = _BASES[0], _room(len(codes))
    sums = _sums(codes, base)
    start = np.arange(len(codes) - n + 1)
    return mixed(_shifted(sums[n:] - sums[:-n], start, base, room) + np.uint64(n))


def spans(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of the word runs start <= i < end."""
    base, room = _BASES[1], _room(len(codes))
    sums = _sums(codes, base)
    return mixed(_shifted(sums[end] - sums[start], start, base, room)
                 + (end - start).astype(np.uint64))


def texts(column: pa.Array) -> Iterator[tuple[int, bytes]]:
    """Row number and UTF-8 bytes of each text of an Arrow column; a null is an empty text."""
    column = column.cast(pa.large_binary())
    for i, value in enumerate(column):
        yield i, value.as_py() or b""


def coded_texts(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Row number, bytes and word codes of each text, coded many texts at a time."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, raw in texts(column):
        held.append((i, raw))
        size += len(raw)
        if size >= HELD:
            yield from _coded(held, lower)
            held, size = [], 0
    yield from _coded(held, lower)


def _coded(held: list[tuple[int, bytes]], lower: bool) -> Iterator[tuple[int, bytes, np.ndarray]]:
    if not held:
        return
    joined = np.frombuffer(b"\n".join(raw for _, raw in held), np.uint8)
    codes, starts = word_codes(joined, lower)
    ends = np.cumsum([len(raw) + 1 for _, raw in held])
    cuts = np.concatenate(([0], np.searchsorted(starts, ends)))
    for k, (i, raw) in enumerate(held):
        yield i, raw, codes[cuts[k]:cuts[k + 1]]


def distinct(codes: np.ndarray) -> np.ndarray:
    """The codes in order, each once."""
    codes = np.sort(codes)
    return codes[np.concatenate(([True], codes[1:] != codes[:-1]))] if len(codes) else codes


def signed(codes: np.ndarray) -> pa.Array:
    """Codes as Spark longs."""
    return pa.array(codes.view(np.int64))
