"""Removal of repeated byte strings with suffix arrays by the difference-cover algorithm.

A byte goes if it lies in a LENGTH-byte string that also starts in a document with a smaller doc_id. A global suffix
array of all bytes isn't needed: each LENGTH-byte window has one anchor, the smallest hash among its GRAM-byte parts
(the first of equals), and equal windows have equal anchors. So

1. one pass gathers the anchors' hashes and marks those met twice in a bitmap of bounded size (which only saves work);
2. a second pass sends each run of windows with one marked anchor (a phrase) by its hash to the anchor's bucket;
   documents after the first that holds the same phrase repeat all of it;
3. where phrases of one anchor begin in different documents, their bytes are fetched, and a bucket, some anchors at a time,
   sorts the suffixes of its distinct phrases by difference cover (sort sampled triples, recurse on names, merge the
   remaining suffixes), compares adjacent prefixes, and takes the smallest document of each LENGTH-byte string;
   an anchor with about HOT phrases or more has no bucket: its phrases are dealt by phrase, and its LENGTH-byte strings by
   string; of a phrase or string that is common itself, the smallest document is aggregated and broadcast, so that its rows
   can be dealt by row;
4. the spans meet their documents again by doc_id and a hash of the row.

A phrase is told from others of its anchor by both hashes, 128 bits in all; other strings are compared as bytes.

Defined results: null texts are empty; texts shorter than LENGTH lose nothing; rows of equal doc_id never repeat each
other, so repeated rows lose the same bytes; rows with a null doc_id lose nothing and count for nothing; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_KEYS, column, dropped, extended, releasing, small_batches, written
from .hashing import mix, series

LENGTH, GRAM = 50, 20
#: Windows of one text handled at a time.
PIECE = 1 << 21
#: Bytes of input for each bucket, and bounds of the bitmap's size in bits (as a power of two).
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 6 << 20, 20, 30
#: Bytes of input whose anchors meet in one task (at least 256 tasks).
PART_BYTES = 16 << 20
#: Phrases from which an anchor is hot, estimated on one in SAMPLED documents.
HOT, SAMPLED = 1 << 14, 64
#: Bytes of phrases whose suffixes are sorted at a time (or those of one anchor): a worker holds about a hundred times as many.
SORTED = 1 << 17
#: Rows from which a phrase of a hot anchor is common: its first document is broadcast (HEAVY_KEYS of them at most, by that estimate).
COMMON = 1 << 10

_U = np.uint64
BASE, BYTES = 0x9E3779B97F4A7C15, series(1, 256)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(1 << max(16, (n - 1).bit_length()), base % 2**64, np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.multiply.accumulate(steps)
    return have[:n]


def _order(*keys: np.ndarray) -> np.ndarray:
    """Order by the keys (not negative), the first one first: by one combined number where that fits into 62 bits."""
    bases = [int(k.max(initial=0)) + 1 for k in keys]
    if math.prod(bases) >= 2**62:
        return np.lexsort(keys[::-1])
    combined = keys[0].astype(np.int64)
    for k, base in zip(keys[1:], bases[1:], strict=True):
        combined = combined * base + k
    return combined.argsort(kind="stable")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s (whole numbers from 1) by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    padded = np.concatenate([s, [0, 0, 0, 0]]).astype(np.int64)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    order = _order(padded[sample], padded[sample + 1], padded[sample + 2])
    at = sample[order]
    new = np.append([True], (padded[at[1:]] != padded[at[:-1]]) | (padded[at[1:] + 1] != padded[at[:-1] + 1]) | (padded[at[1:] + 2] != padded[at[:-1] + 2]))
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    sorted_sample = sample[order]
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    rest = rest[_order(padded[rest], rank[rest + 1])]
    # merge: how many sampled suffixes are smaller than each of the rest; a rank decides after one symbol or after two
    two = sorted_sample % 3 == 2
    low, high = np.zeros(len(rest), np.int64), np.full(len(rest), len(sorted_sample))
    base = int(padded.max()) + 1
    if base * base * (n + 4) < 2**62:
        second = np.where(two, padded[sorted_sample + 1] * (n + 4) + rank[sorted_sample + 2], rank[sorted_sample + 1])
        theirs = padded[sorted_sample] * np.where(two, base * (n + 4), n + 4) + second
        after_one = padded[rest] * (n + 4) + rank[rest + 1]
        after_two = padded[rest] * (base * (n + 4)) + padded[rest + 1] * (n + 4) + rank[rest + 2]
        smaller = lambda j, i: theirs[j] < np.where(two[j], after_two[i], after_one[i])
    else:

        def smaller(j: np.ndarray, i: np.ndarray) -> np.ndarray:
            x, y, t = rest[i], sorted_sample[j], two[j]
            a = (padded[x], np.where(t, padded[x + 1], rank[x + 1]), np.where(t, rank[x + 2], 0))
            b = (padded[y], np.where(t, padded[y + 1], rank[y + 1]), np.where(t, rank[y + 2], 0))
            return (b[0] < a[0]) | (b[0] == a[0]) & ((b[1] < a[1]) | (b[1] == a[1]) & (b[2] < a[2]))

    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        less = smaller(middle, open_)
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    out = np.empty(n, np.int64)
    at = low + np.arange(len(rest))
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = rest, sorted_sample
    return out


def phrases(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hash, phrase hash, first window and number of windows of each phrase of one text."""
    for begin in range(0, len(data) - LENGTH + 1, PIECE):
        part = data[begin : begin + PIECE + LENGTH - 1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[part] * _power(BASE, len(part)))])
        back = _power(pow(BASE, -1, 2**64), len(part))
        gram = mix((total[GRAM:] - total[:-GRAM]) * back[: len(part) - GRAM + 1])
        key = gram & ~_U(0xFFFFFF) | np.arange(len(gram), dtype=np.uint64)
        span, reach = LENGTH - GRAM + 1, 1
        while 2 * reach <= span:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < span:
            key = np.minimum(key[: len(key) - span + reach], key[span - reach :])
        anchor = (key & _U(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append([True], anchor[1:] != anchor[:-1]))
        count = np.diff(np.append(first, len(anchor)))
        content = (total[first + count + LENGTH - 1] - total[first]) * back[first]
        name = mix(mix(content) + count.astype(np.uint64) * _U(1 << 32) + (anchor[first] - first).astype(np.uint64))
        yield gram[anchor[first]], name, first + begin, count


def _texts(texts: pa.Array) -> Iterator[np.ndarray]:
    for t in texts:
        raw = t.as_buffer() if t.is_valid else None
        yield np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)


HEAVY = np.dtype([("anchor", "<u8"), ("phrase", "<u8"), ("doc_id", "<i8"), ("met", "<i8")])


def _reduced(rows: np.ndarray) -> np.ndarray:
    """One row of each phrase (of HEAVY): its smallest document, and how often it was met."""
    rows = rows[np.lexsort((rows["doc_id"], rows["phrase"], rows["anchor"]))]
    new = np.flatnonzero(np.append([True], (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["phrase"][1:] != rows["phrase"][:-1]))[: len(rows)])
    out = rows[new]
    if len(new):
        out["met"] = np.add.reduceat(rows["met"], new)
    return out


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among the given ones (sorted)."""
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values if len(among) else np.zeros(len(values), bool)


def _marked(docs: DataFrame, bits: int, size: int, hot: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of anchors met twice, by their hash's leading bits; and of the phrases of hot anchors, those met least times or more (HEAVY)."""
    lead = min(bits - 3, max(8, (size // PART_BYTES).bit_length()))
    parts = 2**lead

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, common = [np.empty(0, np.uint64)], [np.empty(0, HEAVY)]
            for doc, data in zip(column(batch, "doc_id").to_numpy(), _texts(column(batch, "text")), strict=True):
                own = []
                for a, p, *_ in phrases(data):
                    own.append(a)
                    at = np.flatnonzero(_member(a.view(np.int64), hot))
                    if len(at):
                        rows = np.empty(len(at), HEAVY)
                        rows["anchor"], rows["phrase"], rows["doc_id"], rows["met"] = a[at], p[at], doc, 1
                        common.append(rows)
                if own:
                    found.append(np.unique(np.concatenate(own)))
            hashes, count = np.unique(np.concatenate(found), return_counts=True)
            hashes = np.sort(np.concatenate([hashes, hashes[count > 1]]))
            part = (hashes >> _U(64 - lead)).astype(np.int32)
            cut = np.append(np.flatnonzero(np.append([True], part[1:] != part[:-1]))[: len(part)], len(part))
            names, blobs = list(part[cut[:-1]]), [hashes[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            rows = _reduced(np.concatenate(common))
            of = (rows["phrase"] % _U(parts)).astype(np.int32)
            for k in np.unique(of):
                names.append(parts + k)
                blobs.append(rows[of == k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["part", "hashes"])

    def twice(table: pa.Table) -> pa.Table:
        blob = b"".join(table["hashes"].to_pylist())
        if table["part"][0].as_py() >= parts:
            rows = _reduced(np.frombuffer(blob, HEAVY))
            return pa.table({"part": table["part"][:1], "bits": pa.array([rows[rows["met"] >= least].tobytes()], pa.binary())})
        hashes = np.sort(np.frombuffer(blob, np.uint64))
        again = hashes[1:][hashes[1:] == hashes[:-1]]
        flags = np.zeros(2**bits // parts, bool)
        flags[((again >> _U(64 - bits)) & _U(2**bits // parts - 1)).astype(np.int64)] = True
        return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    flagged = docs.mapInArrow(gather, "part int, hashes binary").groupBy("part").applyInArrow(twice, "part int, bits binary")
    with releasing(docs.sparkSession):
        found = flagged.toArrow()
    out, heavy = np.zeros((parts, 2**bits // parts // 8), np.uint8), [np.empty(0, HEAVY)]
    for part, flags in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        if part < parts:
            out[part] = np.frombuffer(flags, np.uint8)
        else:
            heavy.append(np.frombuffer(flags, HEAVY))
    return out.ravel(), _reduced(np.concatenate(heavy))


def _hot(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Anchors with about HOT phrases or more, sorted, and how many phrases they have. They decide where phrases meet, never the result."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in _texts(column(batch, "text")):
                for a, *_ in phrases(data):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64))], ["anchor"])

    some = docs.filter(F.pmod("row", F.lit(SAMPLED)) == 0).select("text").mapInArrow(anchors, "anchor bigint")
    found = some.groupBy("anchor").count().filter(F.col("count") * SAMPLED >= HOT).select("anchor", "count").toArrow()
    return np.sort(found["anchor"].to_numpy()), SAMPLED * sum(found["count"].to_pylist())


def _earliest(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """rows with earliest, the smallest doc_id among those of equal keys (binary). Common keys are aggregated and broadcast, the others meet
    in buckets."""
    counts = rows.groupBy(key).agg(F.min("doc_id").alias("earliest"), F.count("*").alias("met"))
    total = rows.count()
    common = counts.filter((F.col("met") >= 64) & (F.col("met") * HEAVY_KEYS >= total)).toArrow()  # HEAVY_KEYS rows at most
    known, least = common[key].combine_chunks(), common["earliest"].to_numpy()
    known = known.chunk(0) if isinstance(known, pa.ChunkedArray) and known.num_chunks else known

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.compute.index_in(column(batch, key), value_set=known)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least).take(at)], [*batch.schema.names, "earliest"])

    def find(table: pa.Table) -> pa.Table:
        coded = table[key].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        code, doc = coded.indices.to_numpy(), table["doc_id"].to_numpy()
        first = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(first, code, doc)
        return table.drop_columns(["_bucket", "earliest"]).append_column("earliest", pa.array(first[code]))

    types = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    looked = written(rows.mapInArrow(look, f"{types}, earliest bigint"))
    rest = looked.filter("earliest IS NULL").withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    return looked.filter("earliest IS NOT NULL").unionByName(rest.groupBy("_bucket").applyInArrow(find, f"{types}, earliest bigint"))


def _windows(text: bytes) -> list[bytes]:
    """The LENGTH-byte strings of a phrase."""
    return [text[i : i + LENGTH] for i in range(len(text) - LENGTH + 1)]


KEY = ["doc_id", "row"]
NAMES = ["bucket", "anchor", "phrase", "doc_id", "row", "first", "n"]


def _split(table: pa.Table) -> pa.Table:
    """Of one bucket's phrases: those that an earlier document has, as a whole; and, where phrases of one anchor begin in
    different documents, the rest, whose suffixes are to be compared."""
    anchor, phrase, doc = (table[c].to_numpy() for c in ("anchor", "phrase", "doc_id"))
    order = np.lexsort((doc, phrase, anchor))
    anchor, phrase, doc = anchor[order], phrase[order], doc[order]
    new_anchor = np.append([True], anchor[1:] != anchor[:-1])
    new = new_anchor | np.append([True], phrase[1:] != phrase[:-1])
    kind, group = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
    earliest = doc[new]
    starts = np.flatnonzero(new_anchor)
    of_kind = earliest[kind]
    differ = np.minimum.reduceat(of_kind, starts) < np.maximum.reduceat(of_kind, starts)
    whole = doc > of_kind
    keep = np.flatnonzero(whole | differ[group])
    return table.take(pa.array(order[keep])).append_column("whole", pa.array(whole[keep]))


def _parts(group: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Phrases of SORTED bytes at most, or those of one anchor; an anchor's phrases (its group is sorted) stay together."""
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    total = np.cumsum(sizes)[ends - 1]
    start = i = 0
    while i < len(ends):
        i = max(i + 1, int(np.searchsorted(total, SORTED + (total[i - 1] if i else 0), side="right")))
        yield slice(start, int(ends[i - 1]))
        start = int(ends[i - 1])


def _repeated(pieces: list[np.ndarray], counts: np.ndarray, earliest: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, starts and ends of the runs of each phrase with LENGTH-byte strings that another phrase has in an earlier document."""
    long = np.array([len(p) + 1 for p in pieces])
    begin = np.concatenate([[0], np.cumsum(long)[:-1]])
    whole = np.concatenate([np.append(p.astype(np.int64) + 1, 257 + i) for i, p in enumerate(pieces)])
    of = np.repeat(np.arange(len(pieces)), long)
    order = suffix_array(whole)
    order = order[order - begin[of[order]] < counts[of[order]]]  # starts of windows
    raw = np.concatenate([(whole - 1).astype(np.uint8), np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    eight = np.ascontiguousarray(eight).view(np.uint64).ravel()
    same = np.ones(len(order) - 1, bool)
    for i in [*range(0, LENGTH - 8, 8), LENGTH - 8]:  # a window has no end mark
        word = eight[order + i]
        same &= word[1:] == word[:-1]
    string = np.cumsum(np.append([True], ~same)) - 1
    least = np.full(string[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, string, earliest[of[order]])
    repeated = np.zeros(len(whole) + 1, bool)
    repeated[order[least[string] < earliest[of[order]]]] = True
    for i in np.unique(of[np.flatnonzero(repeated)]):
        flags = np.concatenate([[False], repeated[begin[i] : begin[i] + counts[i]], [False]]).astype(np.int8)
        edge = np.diff(flags)
        yield int(i), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + LENGTH


def _resolve(table: pa.Table) -> pa.Table:
    """Spans that repeat an earlier document, from one bucket's phrases and their bytes."""
    anchor, phrase, doc, row, first, count = (table[c].to_numpy() for c in ("anchor", "phrase", "doc_id", "row", "first", "n"))
    order = np.lexsort((doc, phrase, anchor))
    anchor, phrase, doc, row, first, count = (x[order] for x in (anchor, phrase, doc, row, first, count))
    new_anchor = np.append([True], anchor[1:] != anchor[:-1])
    new = new_anchor | np.append([True], phrase[1:] != phrase[:-1])
    kind = np.cumsum(new) - 1  # of each occurrence
    heads = np.flatnonzero(new)
    earliest = doc[heads]
    later = doc > earliest[kind]
    ids, rows, starts, ends = [doc[later]], [row[later]], [first[later]], [first[later] + count[later] + LENGTH - 1]
    group = np.cumsum(new_anchor)[heads]
    mixed = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(mixed):
        given = table["text"].combine_chunks()
        given = given.chunk(0) if isinstance(given, pa.ChunkedArray) else given
        texts: dict[int, int] = {}
        for i in np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False)[order]):
            texts.setdefault(int(kind[i]), int(order[i]))
        for part in _parts(group[mixed], count[heads[mixed]] + LENGTH - 1):
            some = mixed[part]
            pieces = [np.frombuffer(given[texts[int(k)]].as_buffer(), np.uint8) for k in some]
            for k, a, b in _repeated(pieces, count[heads[some]], earliest[some]):
                k = some[k]
                end = heads[k + 1] if k + 1 < len(heads) else len(doc)
                for o in range(heads[k], end):
                    if doc[o] != earliest[k]:
                        break
                    ids.append(np.repeat(doc[o], len(a)))
                    rows.append(np.repeat(row[o], len(a)))
                    starts.append(first[o] + a)
                    ends.append(first[o] + b)
    return pa.table({"doc_id": np.concatenate(ids), "row": np.concatenate(rows), "first": np.concatenate(starts).astype(np.int64), "last": np.concatenate(ends).astype(np.int64)})


def _split_hot(table: pa.Table) -> pa.Table:
    """Of a bucket of phrases of hot anchors: which an earlier document has. A negative n says so of a common phrase, whose other rows are
    of its first document; the rows of another phrase are all here."""
    anchor, phrase, doc, n = (table[c].to_numpy() for c in ("anchor", "phrase", "doc_id", "n"))
    order = np.lexsort((doc, n < 0, phrase, anchor))
    a, p, d, count = anchor[order], phrase[order], doc[order], n[order]
    new = np.append([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1]))
    whole = (count < 0) | (d > d[new][np.cumsum(new) - 1])
    at = table.schema.get_field_index("n")
    return table.take(pa.array(order)).set_column(at, "n", pa.array(np.abs(count))).append_column("whole", pa.array(whole))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, row, spans: array of (first, last) in bytes, sorted, perhaps overlapping; docs: doc_id, text, row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(size).bit_length() - 3))
    buckets = max(16, size // BUCKET_BYTES)
    dealt = max(buckets, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot, met = _hot(docs)
    bitmap, heavy = _marked(docs.select("doc_id", "text"), bits, size, hot, max(COMMON, met // HEAVY_KEYS))
    shared = spark.sparkContext.broadcast((bitmap, heavy["anchor"] ^ mix(heavy["phrase"]), heavy))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, mixed, heavy = shared.value
        order = np.argsort(mixed)
        mixed, heavy = mixed[order], heavy[order]
        for batch in batches:
            ids, keys = (column(batch, c).to_numpy() for c in ("doc_id", "row"))
            out = []
            for i, data in enumerate(_texts(column(batch, "text"))):
                for a, p, first, count in phrases(data):
                    at = (a >> _U(64 - bits)).astype(np.int64)
                    keep = np.flatnonzero(bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                    n = len(keep)
                    out.append((a[keep].view(np.int64), p[keep].view(np.int64), np.repeat(ids[i], n), np.repeat(keys[i], n), first[keep], count[keep]))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                kinds = [np.int64] * 4 + [np.int32] * 2
                bucket = (cols[0].view(np.uint64) % _U(buckets)).astype(np.int32)
                at = np.flatnonzero(_member(cols[0], hot))
                if len(at):
                    a, p, d, row = (c[at] for c in cols[:4])
                    bucket[at] = buckets + (mix(a.view(np.uint64) ^ mix(p.view(np.uint64))) % _U(dealt)).astype(np.int32)
                    if len(heavy):
                        near = np.minimum(np.searchsorted(mixed, a.view(np.uint64) ^ mix(p.view(np.uint64))), len(mixed) - 1)
                        common = (heavy["anchor"][near] == a.view(np.uint64)) & (heavy["phrase"][near] == p.view(np.uint64))
                        bucket[at[common]] = buckets + (mix(row[common].view(np.uint64)) % _U(dealt)).astype(np.int32)
                        later = at[common & (d > heavy["doc_id"][near])]
                        cols[5][later] = -cols[5][later]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *(pa.array(c.astype(k)) for c, k in zip(cols, kinds, strict=True))], NAMES)

    def split(table: pa.Table) -> pa.Table:
        return _split(table) if table["bucket"][0].as_py() < buckets else _split_hot(table)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The phrases asked for, with their bytes; those of hot anchors as LENGTH-byte strings."""
        for batch in batches:
            asked = column(batch, "asked")
            which = pa.compute.list_parent_indices(asked).to_numpy()
            flat = pa.compute.list_flatten(asked)
            data = list(_texts(column(batch, "text")))
            from_, texts, starts, sizes = [], [], [], []
            for j, (i, bucket, first, n) in enumerate(zip(which.tolist(), flat.field("bucket").to_pylist(), flat.field("first").to_pylist(), flat.field("n").to_pylist(), strict=True)):
                text = data[i][first : first + n + LENGTH - 1].tobytes()
                strings = [text] if bucket < buckets else _windows(text)
                from_ += [j] * len(strings)
                texts += strings
                starts += [first] if bucket < buckets else range(first, first + n)
                sizes += [n] if bucket < buckets else [1] * n
            at = pa.array(from_, pa.int64())
            fields = {k: flat.field(k).take(at) for k in NAMES if k not in KEY} | {k: column(batch, k).take(pa.array(which[from_] if from_ else which[:0])) for k in KEY}
            fields |= {"first": pa.array(starts, pa.int32()), "n": pa.array(sizes, pa.int32())}
            yield pa.RecordBatch.from_arrays([*(fields[k] for k in NAMES), pa.array(texts, pa.binary())], [*NAMES, "text"])

    types = "bucket int, anchor bigint, phrase bigint, doc_id bigint, row bigint, first int, n int"
    found = written(docs.mapInArrow(send, types).groupBy("bucket").applyInArrow(split, f"{types}, whole boolean"))
    asked = found.filter("not whole").groupBy("doc_id", "row").agg(F.collect_list(F.struct(*(k for k in NAMES if k not in KEY))).alias("asked"))
    fetched = docs.join(asked, KEY).select(*KEY, "text", "asked").mapInArrow(cut, f"{types}, text binary")
    if len(hot):
        fetched = written(fetched)
    partly = written(fetched.filter(F.col("bucket") < buckets).groupBy("bucket").applyInArrow(_resolve, "doc_id bigint, row bigint, first bigint, last bigint"))
    both = found.filter("whole").select(*KEY, "first", (F.col("first") + F.col("n") + LENGTH - 1).alias("last")).union(partly.select(*KEY, F.col("first").cast("int"), F.col("last").cast("int")))
    if len(hot):
        strings = fetched.filter(F.col("bucket") >= buckets).select(*KEY, "first", F.col("text").alias("string"))
        repeated = written(_earliest(strings, "string", dealt).filter("doc_id > earliest").select(*KEY, "first"))
        both = both.union(repeated.select(*KEY, "first", F.col("first") + LENGTH))
        dropped(fetched)
    return both.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def remove(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """document (a struct of the columns of docs), n_bytes, n_removed, n_spans and kept (binary: the remaining bytes) of each row of docs.

    whole_characters shrinks the removed runs to UTF-8 boundaries, so that kept stays valid text.
    """
    small_batches(docs.sparkSession)
    row = F.xxhash64("doc_id", "text").alias("row")
    whole = docs.select(F.struct(*docs.columns).alias("document"), "doc_id", row)
    found = spans(docs.select("doc_id", "text", row).filter(F.col("doc_id").isNotNull()))
    joined = whole.join(found, KEY, "left").select("document", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, documents = [], column(batch, "document")
            for data, own in zip(_texts(documents.field("text")), column(batch, "spans"), strict=True):
                n = len(data)
                if not own.is_valid or n == 0:
                    out.append((n, 0, 0, data.tobytes()))
                    continue
                first, last = (own.values.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
                edge = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
                gone = np.cumsum(edge)[:n] > 0
                if whole_characters:
                    lead = (data & 0xC0) != 0x80
                    character = np.cumsum(lead) - 1
                    gone = (np.bincount(character, ~gone) == 0)[character]
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                out.append((n, int(gone.sum()), runs, data[~gone].tobytes()))
            n, removed, runs, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([documents, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["document", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, extended(joined.select("document"), "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    return remove(docs.select("doc_id", "text")).select("document.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
