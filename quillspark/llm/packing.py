"""Harmonic packing of documents into sequences of at most CAPACITY tokens.

A piece of length r belongs to class k = CAPACITY // r, whose sequences hold k pieces each: whatever pieces of a class come,
k of them fit. Each worker fills the sequences of its classes by itself, so nothing is shuffled. Plain harmonic packing
pads up to half of a sequence; here documents may be cut, so only lengths that nearly fill their class are used: those
with CAPACITY % r <= slack. A document gives whole sequences, and its rest is cut into the fewest such lengths. Classes that a
worker leaves unfinished (fewer than CAPACITY tokens each) are strung together and cut anew at CAPACITY, their end at powers of
two, since such sequences need no padding. A sequence is thus padded by slack tokens at most.

Ids are those of the `tokenizers` library for the given file. tiktoken, loaded from the same file, finds them (tests compare
both); it takes a fifth of the time.

Defined results: a null text is empty, and an empty one is its end id alone; special strings within a text are
ordinary text; equal rows (and ids) are packed each for itself; null ids stay null; an empty table gives no rows; texts of any
length are packed whole; other columns are ignored. sequence_id names the worker's partition and its sequence: rerun on
the same partitions it is the same, so let documents be a scan or a written table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import CUTS, pieces
from .common import column, small_batches

CAPACITY = 1024
#: Tokens that a sequence of a class may lack.
SLACK = 8
#: The id behind each document.
END = 0
#: Bits of sequence_id that count the sequences of a partition.
SHIFT = 33
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of the tokens' bytes, of a byte-level BPE file of `tokenizers` (its merges are in the order of the ids)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    special = {k for k in model["vocab"] if any(c not in byte_of for c in k)}
    return {bytes(byte_of[c] for c in k): i for k, i in model["vocab"].items() if k not in special and k != "<|endoftext|>"}


def parts_of(capacity: int = CAPACITY, slack: int = SLACK) -> list[list[int]]:
    """For each length below the capacity the fewest lengths that fill their class but for slack tokens and sum to it, longest first."""
    good = [r for r in range(1, capacity + 1) if capacity % r <= slack]
    fewest, last = [0] + [2 * capacity] * (capacity - 1), [0] * capacity
    for n in range(1, capacity):
        for r in reversed(good):
            if r <= n and fewest[n - r] + 1 < fewest[n]:
                fewest[n], last[n] = fewest[n - r] + 1, r
    out: list[list[int]] = [[]]
    for n in range(1, capacity):
        out.append(sorted([last[n], *out[n - last[n]]], reverse=True))
    return out


class Packer:
    """Sequences of one worker. A piece is (document, start, ids); add() and rest() give rows of OUT but for the partition."""

    def __init__(self, capacity: int = CAPACITY, slack: int = SLACK):
        self.capacity, self.parts = capacity, parts_of(capacity, slack)
        self.open: dict[int, list[tuple]] = {}
        self.sequences = 0

    def _closed(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for (doc, tokens), start, ids in pieces:
            yield doc, start, len(ids), zlib.crc32(ids), tokens, self.sequences, at
            at += len(ids)
        self.sequences += 1

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) - len(ids) % self.capacity
        owner = (doc, len(ids))
        for start in range(0, whole, self.capacity):
            yield from self._closed([(owner, start, ids[start : start + self.capacity])])
        start = whole
        for n in self.parts[len(ids) - whole]:
            k = self.capacity // n
            held = self.open.setdefault(k, [])
            held.append((owner, start, ids[start : start + n].copy()))  # a view would hold the whole document
            start += n
            if len(held) == k:
                yield from self._closed(self.open.pop(k))

    def rest(self) -> Iterator[tuple]:
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        size = sum(len(ids) for _, _, ids in left)
        lengths = [self.capacity] * (size // self.capacity) + [1 << b for b in reversed(range(self.capacity.bit_length())) if size % self.capacity >> b & 1]
        for length in lengths:
            own = []
            while length:
                owner, start, ids = left.pop(0)
                own.append((owner, start, ids[:length]))
                if len(ids) > length:
                    left.insert(0, (owner, start + length, ids[length:]))
                length -= len(own[-1][2])
            yield from self._closed(own)


def pack(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """A row (OUT) for each piece of each row of docs."""
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = [f.split()[0] for f in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        packer, partition, cut = Packer(capacity, slack), TaskContext.get().partitionId() << SHIFT, CUTS.get(pattern)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(names)
            columns[5] = pa.array(columns[5].to_numpy() + partition)
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                text = text.as_py() or ""
                ids = [np.array(encoding.encode_ordinary(p), np.uint32) for p in pieces(text, cut)]
                rows += packer.add(doc, np.concatenate([*ids, np.array([END], np.uint32)]).astype("<u4", copy=False))
            yield table(rows)
        yield table(list(packer.rest()))

    return docs.select("doc_id", "text").mapInArrow(run, OUT)
