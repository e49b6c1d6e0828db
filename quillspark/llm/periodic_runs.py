"""Maximal periodic runs of words, found by block convolution.

Texts become whole numbers, one for each distinct word. At each dyadic scale B the words are cut into blocks of B; for each block
the squared differences to the words behind it are summed at all distances of the scale by a number-theoretic transform,
and a sum of zero is an occurrence. Transforms are exact: sums are found modulo one prime, or several where they may exceed it.
A run of period d is at least 2 * d long, so for d of 2B - 1 to 4B - 2 it holds a whole block with its copy d further on;
the smallest scale takes periods 1 to 6 of runs of at least 12 words. Blocks with a word that doesn't recur in
their window can't occur in it and aren't transformed. Neighbouring blocks with the same distance seed one
extension, shorter than a block on either side.

The texts of a chunk are searched together, with a number of its own between any two of them, so no run crosses it.

Defined results: a null or empty text, or one of blanks, has no words and no runs; the text of a row without an id is
searched as it is (nothing is laid into it); rows are handled one by one, so repeated rows get equal results; texts
of any length are searched whole, a long one in a chunk of its own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, chunks, column, small_batches

#: Words of the shortest run.
SHORTEST = 12
#: The smallest scale; it takes periods up to 4 * SMALLEST - 2.
SMALLEST = 2
#: Primes with a root of unity of order 2 ** 23, and a generator of each.
PRIMES = ((998_244_353, 3), (469_762_049, 3), (167_772_161, 3))
#: Numbers that a batch of transforms holds, and steps of an extension looked at together.
BATCH, STEPS = 1 << 18, 32
#: Bytes of text that become Python words at a time.
PIECE = 1 << 20
OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@lru_cache(64)
def _roots(size: int, prime: int, generator: int, inverse: bool) -> np.ndarray:
    root = pow(generator, (prime - 1) // size, prime)
    root = pow(root, -1, prime) if inverse else root
    out = np.ones(size // 2, np.uint64)
    known = 1
    while known < len(out):
        out[known : 2 * known] = out[:known] * np.uint64(pow(root, known, prime)) % np.uint64(prime)
        known *= 2
    return out


def transform(x: np.ndarray, prime: int, generator: int, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row, whose length is a power of two (the inverse without its factor 1 / length)."""
    p, (rows, size) = np.uint64(prime), x.shape
    roots = _roots(size, prime, generator, inverse)
    half, x = size // 2, x.reshape(rows, 1, size)
    while half:  # each round splits the frequencies by parity; rows of a group are interleaved, so the output is in order
        a, b = x[:, :, :half], x[:, :, half:]
        step = roots[:: len(roots) // half]
        even, odd = (a + b) % p, (a + (p - b)) * step % p
        x = np.concatenate([even, odd], axis=1).reshape(rows, -1, half)
        half //= 2
    return x.reshape(rows, size)


def _zeros(words: np.ndarray, at: np.ndarray, block: int, low: int, high: int, prime: int, generator: int) -> np.ndarray:
    """For each block (its first place) and each distance from low to high, whether the squared differences sum to zero modulo the prime."""
    p = np.uint64(prime)
    window = block + high - low
    size = 1 << (window - 1).bit_length()
    a = np.zeros((len(at), size), np.uint64)
    b = np.zeros((len(at), size), np.uint64)
    a[:, :block] = words[at[:, None] + np.arange(block - 1, -1, -1)]
    behind = at[:, None] + low + np.arange(window)
    b[:, :window] = words[np.minimum(behind, len(words) - 1)]
    # a is reversed: place block - 1 + t of the product is the sum over j of a[j] * b[j + t]
    product = transform(a, prime, generator) * transform(b, prime, generator) % p
    product = transform(product, prime, generator, inverse=True)[:, block - 1 : window] * np.uint64(pow(size, -1, prime)) % p
    squares = np.cumsum(b[:, :window] * b[:, :window] % p, axis=1)
    squares = np.concatenate([np.zeros((len(at), 1), np.uint64), squares], axis=1)
    moved = squares[:, block:] - squares[:, : window - block + 1]
    own = (a * a % p).sum(axis=1, keepdims=True)
    return (own + moved + (p - product) * np.uint64(2)) % p == 0


def occurrences(words: np.ndarray, at: np.ndarray, block: int, low: int, high: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of each block that occurs again at a distance from low to high; words are at most largest."""
    size = 1 << (block + high - low - 1).bit_length()
    found = []
    for i in range(0, len(at), max(1, BATCH // size)):
        part = at[i : i + max(1, BATCH // size)]
        hits, known = np.ones((len(part), high - low + 1), bool), 1
        for prime, generator in PRIMES:
            some = np.flatnonzero(hits.any(axis=1))
            if known > block * largest * largest or not len(some):
                break
            hits[some] &= _zeros(words, part[some], block, low, high, prime, generator)
            known *= prime
        row, t = np.nonzero(hits)
        found.append((part[row], t + low))
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def _reach(words: np.ndarray, at: np.ndarray, distance: np.ndarray, way: int) -> np.ndarray:
    """How far from each place, in steps of way, words equal those at the distance."""
    out, alive, last = np.zeros(len(at), np.int64), np.arange(len(at)), len(words) - 1
    while len(alive):
        i = at[alive, None] + way * (out[alive, None] + np.arange(STEPS))
        equal = words[np.clip(i, 0, last)] == words[np.clip(i + distance[alive, None], 0, last)]
        steps = np.where(equal.all(axis=1), STEPS, equal.argmin(axis=1))
        out[alive] += steps
        alive = alive[steps == STEPS]
    return out


def runs(words: np.ndarray, longest: int) -> np.ndarray:
    """start, end, period of each run, by start and period.

    words: uint64, of which the first, the last and those between texts occur once; longest: words of the longest text.
    """
    n, largest = len(words), int(words.max(initial=0))
    order = np.argsort(words, kind="stable")
    again = np.flatnonzero(words[order[1:]] == words[order[:-1]])
    nearest = np.full(n, 1 << 62, np.int64)  # distance to the next equal word
    nearest[order[again]] = order[again + 1] - order[again]
    found = np.empty((0, 3), np.int64)
    block = SMALLEST
    while block == SMALLEST or 2 * block - 1 <= longest // 2:
        low, high = 1 if block == SMALLEST else 2 * block - 1, 4 * block - 2
        whole = n // block * block
        at = np.flatnonzero((nearest[:whole] <= high).reshape(-1, block).all(axis=1)) * block
        at, distance = occurrences(words, at, block, low, high, largest)
        inner = np.zeros(len(at), bool)
        for s, e, q in found[found[:, 1] - found[:, 0] >= block + low]:  # what a shorter period has covered extends to the same run
            i, j = np.searchsorted(at, (s, e))
            inner[i:j] |= (at[i:j] + block + distance[i:j] <= e) & (distance[i:j] % q == 0)
        at, distance = at[~inner], distance[~inner]
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        head = np.ones(len(at), bool)
        head[1:] = (distance[1:] != distance[:-1]) | (at[1:] != at[:-1] + block)
        first = np.flatnonzero(head)
        tail = np.append(first[1:], len(at))[: len(first)] - 1
        start, end, period = at[first], at[tail] + block, distance[first]
        start = start - _reach(words, start - 1, period, -1)
        end = end + _reach(words, end, period, 1) + period
        long = end - start >= np.maximum(SHORTEST, 2 * period)
        new = np.stack([start, end, period], axis=1)[long]
        new = new[np.lexsort((new[:, 2], new[:, 1], new[:, 0]))]
        # of the same stretch, only the smallest period counts
        same = np.zeros(len(new), bool)
        same[1:] = (new[1:, :2] == new[:-1, :2]).all(axis=1)
        found = np.concatenate([found, new[~same]])
        block *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word of the text, and the words by number."""
    known, parts, start = _Numbers(), [], 0
    while start < len(text):
        end = len(text)
        if end - start > PIECE:
            end = next((i for i in range(start + PIECE, len(text)) if text[i] in b" \t\n\v\f\r"), len(text))
        parts.append(np.fromiter(map(known.__getitem__, text[start:end].split()), np.int64))
        start = end
    return np.concatenate([np.empty(0, np.int64), *parts]), list(known)


def planted(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words as the contract of the query changes them: by the hash of the id, a period is laid into some texts."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return words[np.where(i < a, i, a + (i - a) % p)]


def _digest(words: np.ndarray, names: list[bytes]) -> str:
    out = hashlib.sha256()
    for i in range(0, len(words), PIECE):
        out.update(b" " * (i > 0) + b" ".join(map(names.__getitem__, words[i : i + PIECE].tolist())))
    return out.hexdigest()


def _row(doc_id: int | None, words: np.ndarray, names: list[bytes], own: np.ndarray) -> tuple:
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in own.tolist())
    best: tuple = (None,) * 4
    edges = np.zeros(len(words) + 1, np.int64)
    if len(own):
        length = own[:, 1] - own[:, 0]
        s, e, q = own[np.lexsort((own[:, 2], own[:, 0], -length))[0]].tolist()
        best = s, e - s, q, 1000 * (e - s) // q
        np.add.at(edges, own[:, 0] + own[:, 2], 1)
        np.add.at(edges, own[:, 1], -1)
    kept = words[np.cumsum(edges[:-1]) == 0]
    return doc_id, len(own), *best, hashlib.sha256(listed.encode()).hexdigest(), _digest(kept, names)


def searched(rows: list[tuple[int | None, np.ndarray, list[bytes]]]) -> Iterator[tuple]:
    """A row (OUT) for each (id, words, names), whose words are searched together."""
    if not rows:
        return
    base = max((int(w.max(initial=0)) for _, w, _ in rows), default=0) + 1  # numbers from here on stand between texts
    joined = np.concatenate([np.append(base + i, w) for i, (_, w, _) in enumerate(rows)] + [np.array([base + len(rows)])]).astype(np.uint64)
    ends = np.cumsum([len(w) + 1 for _, w, _ in rows])
    found = runs(joined, max(len(w) for _, w, _ in rows))
    cuts = np.searchsorted(found[:, 0], np.append(0, ends))
    for i, (doc_id, words, names) in enumerate(rows):
        first = ends[i] - len(words)
        yield _row(doc_id, words, names, found[cuts[i] : cuts[i + 1]] - np.array([[first, first, 0]]))


def find(docs: DataFrame, plant: bool = True) -> DataFrame:
    """A row (OUT) for each row of docs; plant: lay periods into texts as the query's contract says."""
    small_batches(docs.sparkSession)
    names_out = [f.split()[0] for f in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, ids = [], 0, column(batch, "doc_id").to_pylist()
            for texts in chunks(column(batch, "text"), CHUNK_BYTES):
                own = []
                for text in texts:
                    words, names = numbered((text.as_py() or "").encode())
                    own.append((ids[at], planted(words, ids[at]) if plant else words, names))
                    at += 1
                rows += searched(own)
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names_out)

    return docs.select("doc_id", "text").mapInArrow(run, OUT)
