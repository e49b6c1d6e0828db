"""64-bit hashes of the words, lines or other runs of bytes of texts, in numpy.

A run's hash sums a random number for each of its (place, byte) pairs and mixes the sum with the length: unlike a
polynomial modulo 2 ** 64 it has no structured collisions (such as a Thue-Morse word and its complement).
"""

from __future__ import annotations

import numpy as np

#: Bytes of one text handled at a time.
PIECE = 4 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def series(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


#: Places of a run whose numbers are looked up; those of later places are computed.
PLACES = 32
NUMBERS = series(1, PLACES * 256)
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
NEWLINES = np.zeros(256, bool)
NEWLINES[10] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32


def cuts(data: np.ndarray, separator: np.ndarray, piece: int | None = None) -> list[tuple[int, int]]:
    """Parts of one text of about PIECE bytes, each of which starts at its beginning or at a separator."""
    out, start, piece = [], 0, piece or PIECE
    while start < len(data):
        end = len(data)
        for at in range(start + piece, len(data), piece):  # a run may be longer than a piece
            gap = np.flatnonzero(separator[data[at : at + piece]])[:1]
            if len(gap):
                end = at + int(gap[0])
                break
        out.append((start, end))
        start = end
    return out


def runs(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = BLANKS, as_read: np.ndarray = AS_IS) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of bytes between separators, and how many runs each text has; runs end with their text."""
    if len(data) == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    if len(offsets) == 2 and len(data) > PIECE:
        found = np.concatenate([_runs(data[a:b], np.array([0, b - a]), separator, as_read)[0] for a, b in cuts(data, separator)])
        return found, np.array([len(found)])
    return _runs(data, offsets, separator, as_read)


def _runs(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, as_read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    gap = separator[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = ~gap & (first[:-1] | np.concatenate([[True], gap[:-1]]))
    end = ~gap & (first[1:] | np.concatenate([gap[1:], [True]]))
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    place = np.arange(n, dtype=np.int32)
    place -= np.maximum.accumulate(np.where(start, place, np.int32(0)))
    number = NUMBERS[(np.minimum(place, np.int32(PLACES - 1)) << np.int32(8)) | as_read[data]]
    late = np.flatnonzero(place >= PLACES)
    if len(late):
        number[late] = mix(((place[late].astype(np.uint64) << _U(8)) | as_read[data[late]]) * _U(0xD1B54A32D192ED03) + _U(5))
    total = np.cumsum(number, out=number)
    before = np.where(s > 0, total[s - 1], _U(0))
    return mix(total[e] - before + (e - s + 1).astype(np.uint64) * _U(0x9E3779B97F4A7C15)), np.diff(np.searchsorted(s, offsets))


def distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, of))
    h, of = hashes[order], of[order]
    new = np.append([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
    return np.bincount(of[new], minlength=len(counts))
