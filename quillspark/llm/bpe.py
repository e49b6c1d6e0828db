"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves a whole pre-token to its rank. It holds packed seeds, ranks and
the keys' bytes, no object for each key. Tier 2, for pre-tokens outside the vocabulary: a heap of candidate merges over
doubly linked bytes, lowest rank first and leftmost among equals; the ranks of merged parts come from the same hash.
Workers remember recent pre-tokens and parts in bounded tables.
The vocabulary is a parameter (its rank file); tables are built once on the driver and broadcast (bounded by the
vocabulary). Encoding and decoding are passes of Arrow batches without a shuffle.

Defined results: a null text counts as empty and has no ids; null ids decode to no bytes; rows are handled one by
one, so repeated rows get equal results; texts of any length are encoded whole (long ones in pieces, where the pattern is
known to end a match at the cut); extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches

#: Pre-tokens that a worker remembers within a task, those it keeps beyond that (the ones it met first), and the longest of them in characters.
REMEMBERED, KEPT, REMEMBERED_CHARS = 400_000, 100_000, 64
#: Longer texts are cut before a blank between two letters, where these patterns end a match anyway; for others they aren't.
PIECE = 1 << 20
CUTS = {public_tokenizers.PATTERN: regex.compile(r"(?<=\p{L}) (?=\p{L})")}


def _hashes(key: bytes) -> tuple[int, int, int]:
    d = hashlib.blake2b(key, digest_size=12).digest()
    return int.from_bytes(d[:4], "little"), int.from_bytes(d[4:8], "little"), int.from_bytes(d[8:], "little")


@dataclass(frozen=True)
class Vocabulary:
    """A minimal perfect hash: slot = h1 + seed * h2 (mod n) with the seed of the bucket of h0; a negative seed names the slot itself."""

    seeds: array
    ranks: array
    ends: array
    blob: bytes

    @staticmethod
    def build(ranks: dict[bytes, int]) -> Vocabulary:
        n = len(ranks)
        buckets: list[list[tuple[bytes, int, int]]] = [[] for _ in range(n // 2 + 1)]
        for key in ranks:
            h0, h1, h2 = _hashes(key)
            buckets[h0 % len(buckets)].append((key, h1, h2))
        seeds, slots, free = [0] * len(buckets), [None] * n, set(range(n))
        for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) == 1:
                slot = free.pop()
                seeds[b], slots[slot] = -slot - 1, own[0][0]
                continue
            seed = 0
            while own:
                at = {(h1 + seed * h2) % n for _, h1, h2 in own}
                if len(at) == len(own) and at <= free:
                    for key, h1, h2 in own:
                        slots[(h1 + seed * h2) % n] = key
                    free -= at
                    break
                seed += 1
            seeds[b] = seed
        return Vocabulary(array("q", seeds), array("l", (ranks[k] for k in slots)), array("q", accumulate(map(len, slots), initial=0)), b"".join(slots))

    def rank(self, key: bytes) -> int | None:
        n = len(self.ranks)
        if not n:
            return None
        h0, h1, h2 = _hashes(key)
        seed = self.seeds[h0 % len(self.seeds)]
        slot = -seed - 1 if seed < 0 else (h1 + seed * h2) % n
        return self.ranks[slot] if self.blob[self.ends[slot] : self.ends[slot + 1]] == key else None


class _Pairs(dict):
    """Ranks of two bytes, by the number 256 * first + second."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, pair: int) -> int | None:
        rank = self[pair] = self.vocabulary.rank(bytes((pair >> 8, pair & 255)))
        return rank


class _Parts(dict):
    """Ranks of parts of pre-tokens (None outside the vocabulary), of which the recent ones are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.single = [vocabulary.rank(bytes((b,))) for b in range(256)]
        self.pairs = _Pairs(vocabulary)

    def __missing__(self, part: bytes) -> int | None:
        rank = self.vocabulary.rank(part)
        if len(part) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                _shrink(self)
            self[part] = rank
        return rank


def merge(piece: bytes, rank: _Parts) -> list[int]:
    """Ids of bytes that aren't in the vocabulary as a whole.

    Parts are linked by the places where they and their neighbours begin. A candidate is one number: its rank, then
    where it begins and ends, so that the smallest is the leftmost of the lowest rank; it is stale unless two parts that
    are neighbours still make it up.
    """
    n = len(piece)
    bits = n.bit_length()
    mask, two = (1 << bits) - 1, 2 * bits
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ids, pairs = [rank.single[b] for b in piece], rank.pairs
    heap = [r << two | i << bits | i + 2 for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False)) if (r := pairs[a << 8 | b]) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i, end = top >> bits & mask, top & mask
        j = after[i]
        if not j or j == n or after[j] != end:  # a part that was merged into the one before it has no place behind it
            continue
        ids[i] = top >> two
        after[i], after[j] = end, 0
        if end < n:
            before[end] = i
            last = after[end]
            if (r := rank[piece[i:last]]) is not None:
                heappush(heap, r << two | i << bits | last)
        first = before[i]
        if first >= 0 and (r := rank[piece[first:end]]) is not None:
            heappush(heap, r << two | first << bits | end)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def _shrink(memory: dict) -> None:
    """Forget all but the entries met first, among which are the common ones."""
    first = list(islice(memory.items(), min(KEPT, REMEMBERED // 2)))
    memory.clear()
    memory.update(first)


class _Memory(dict):
    """Ids of pre-tokens, as the bytes of 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.of_parts = _Parts(vocabulary)

    def __missing__(self, token: str) -> bytes:
        key = token.encode()
        rank = self.vocabulary.rank(key)
        ids = array("i", (rank,) if rank is not None else merge(key, self.of_parts)).tobytes()
        if len(token) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                _shrink(self)
            self[token] = ids
        return ids


def pieces(text: str, cut: regex.Pattern | None) -> Iterator[str]:
    start = 0
    while cut and len(text) - start > PIECE and (m := cut.search(text, start + PIECE)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def tokens(text: str, pattern: regex.Pattern, memory: _Memory) -> np.ndarray:
    return np.frombuffer(b"".join(chain.from_iterable(map(memory.__getitem__, pattern.findall(p)) for p in pieces(text, CUTS.get(pattern.pattern)))), np.int32)


def load(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


_workers: dict[int, _Memory] = {}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and ids array<int> of the whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.build(ranks))
    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _workers:
            _workers.clear()
            _workers[number] = _Memory(shared.value)
        memory, split = _workers[number], regex.compile(pattern)
        for batch in batches:
            rows = [tokens(t, split, memory) if t else np.empty(0, np.int32) for t in column(batch, "text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), ids], [*keep, "ids"])
        for remembered in (memory, memory.of_parts):  # the worker may be idle, or serve other operators, from here on
            if len(remembered) > KEPT:
                _shrink(remembered)

    fields = ", ".join(f"`{k}` {t}" for k, t in kept.dtypes if k in keep)
    return kept.mapInArrow(run, f"{fields}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The columns keep, and decoded binary: the bytes of the ids."""
    small_batches(encoded.sparkSession)
    words = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    table = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    shared = encoded.sparkSession.sparkContext.broadcast((table, ends - [len(w) for w in words], ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of, first, last = shared.value
        for batch in batches:
            out = []
            for ids in column(batch, "ids"):
                at = ids.values.to_numpy() if ids.is_valid else np.empty(0, np.int32)
                long = last[at] - first[at]
                shift = first[at] - np.cumsum(long) + long
                out.append(bytes_of[np.repeat(shift, long) + np.arange(long.sum())].tobytes())
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), pa.array(out, pa.binary())], [*keep, "decoded"])

    fields = ", ".join(f"`{k}` {t}" for k, t in encoded.dtypes if k in keep)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs."""
    both = decode(encode(docs, ranks, pattern), ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
