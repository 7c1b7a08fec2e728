"""Words and their hashes over the UTF-8 bytes of whole texts, vectorised with numpy.

A word is a run of bytes outside the six ASCII white-space characters, which is
``bytes.split()``; ``bytes.lower()`` lower-cases A-Z alone.  Word hashes are
polynomials over Z/2^64 with random byte values and an odd base, then mixed, so
that a text costs a few array passes and no Python call a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of a text that are held as arrays at once; a longer text goes through in blocks cut at white space.
BLOCK_BYTES = 1 << 18

_U = np.uint64
_GOLDEN, _MIX_A, _MIX_B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _MIX_A
    x = (x ^ (x >> _U(27))) * _MIX_B
    return x ^ (x >> _U(31))


def table_of(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


IS_SPACE = table_of(SPACES)
_BYTE_VALUE = mix((np.arange(256, dtype=_U) + _U(1)) * _GOLDEN)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(12, n - 1).bit_length() if n > 4096 else 4096
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Consecutive parts of about ``size`` bytes that end at white space."""
    if len(data) <= size:
        yield data
        return
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            ends = [e for e in (data.find(bytes([c]), end) for c in SPACES) if e >= 0]
            end = min(ends, default=len(data))
        yield data[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash a word, in order."""
    parts = [_block_hashes(b) for b in blocks(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _edges(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and one past where they end."""
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[a]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _block_hashes(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, _U)
    a = np.frombuffer(data, np.uint8)
    starts, ends = _edges(a)
    return _hashes(a, starts, ends)


def _hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers_to(len(a))
    sums = np.zeros(len(a) + 1, _U)
    np.cumsum(_BYTE_VALUE[a] * power, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _GOLDEN)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` consecutive words; empty if there are fewer."""
    if len(words) < n:
        return np.empty(0, _U)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * _MIX_B + _GOLDEN) + words[k : len(words) - n + 1 + k]
    return mix(out)


class Words(NamedTuple):
    hashes: np.ndarray
    start_points: np.ndarray  # code points before the word
    end_points: np.ndarray  # and before what follows it
    marked: np.ndarray  # its last byte is a mark
    newline_after: np.ndarray  # a line ends between it and the next word, or the text's end


def scan_words(data: bytes, marks: np.ndarray) -> Words:
    """The words of a text with their places; ``marks`` is a table of bytes."""
    parts, points = [], 0
    for block in blocks(data):
        a = np.frombuffer(block, np.uint8)
        starts, ends = _edges(a)
        before = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
        lines = np.concatenate([[0], np.cumsum(a == 10)])
        following = np.concatenate([starts[1:], [len(a)]]) if len(starts) else starts
        parts.append((_hashes(a, starts, ends), before[starts] + points, before[ends] + points, marks[a[ends - 1]], lines[following] > lines[ends], lines[starts[0]] > 0 if len(starts) else lines[-1] > 0))
        points += int(before[-1])
    carried = False  # a block may begin with the line end that follows the last word of the one before
    for k, part in reversed(list(enumerate(parts))):
        if len(part[0]) and carried:
            part[4][-1] = True
        carried = bool(part[5]) or (carried and not len(part[0]))
    return Words(*(np.concatenate([p[c] for p in parts]) for c in range(5)))


def sequence_hashes(words: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """One hash for each run of words [start, stop)."""
    power, inverse = _powers_to(len(words) + 1)
    sums = np.zeros(len(words) + 1, _U)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(_U) * _GOLDEN)
