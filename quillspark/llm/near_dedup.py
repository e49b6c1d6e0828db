"""Near-duplicates of word shingles by b-bit MinHash.

One pass turns each text into a set of hashed shingles, a digest of the set, band keys of its minima, and a packed
signature of the minima's low bits. Documents with equal sets are one class. In each bucket of a band, members are
first paired with one representative; pairs whose collision-corrected estimate (by bit counts) is well below the
threshold go, and the rest are confirmed on full shingle sets. Confirmed links are joined into components. Buckets
whose other members still lie in several components are cut into blocks, and each two blocks of a bucket meet in one
group of bounded rows and bytes: first the signatures, to find members that have a likely partner in another component,
then the full sets of those members alone. A group gives at most one link for each member, since a link between
members that it has joined already adds nothing; no pairs are emitted. So each pair of a bucket is linked, in one component, or was
compared. Nothing is capped. Signatures meet in numpy, 64 bytes a pair, so a bucket of many members that are alike but not
linked costs the square of its members there, in blocks that Spark spreads; full sets are sent for likely partners alone.

Buckets and classes that hold much of all rows are joined by broadcasting their one row (HEAVY_KEYS at most); the rows of
labels are a few numbers, and joins with a large component's label are left to adaptive splitting. Texts whose sets are
needed are picked before they are shuffled, by their ids where these are few enough to be broadcast.

Bands have 24 x 5 minima: a pair at similarity 0.85 misses all of them with probability 1e-6, at 0.8 with 7e-5. The
estimate has a standard deviation of 0.04 at most; pairs go at 0.2 below the threshold.

Defined results: texts without words (or null) have no shingles and link with nothing; texts with fewer words than
a shingle are one shingle; rows of one doc_id count as one document, which links by each of its texts; rows with a null
doc_id are no documents that a component could name: they link with nothing, have a null component and are kept; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, column, dropped, few, flat, matched, small_batches, written
from .hashing import BLANKS, LOWER, PIECE, mix, runs, series

BANDS, ROWS, BITS = 24, 5, 4
PERMUTATIONS = 128
LANES = PERMUTATIONS * BITS // 64
#: How far below the threshold an estimate may be.
MARGIN = 0.2
#: Members and shingles of one block of a bucket (a single larger text is a block by itself).
BLOCK_ROWS, BLOCK_SHINGLES = 512, 500_000

_U = np.uint64


MULTIPLY, ADD = series(2, PERMUTATIONS) | _U(1), series(3, PERMUTATIONS)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct shingles of one text's words."""
    if len(hashes) == 0:
        return hashes
    if len(hashes) < k:
        h = np.array([len(hashes)], np.uint64)
        for i in range(len(hashes)):
            h = mix(h * _U(31) + hashes[i : i + 1])
        return h
    h = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(h)


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for part in chunks(texts):
        hashes, counts = runs(*flat(part), BLANKS, LOWER)
        yield from (shingles(h, k) for h in np.split(hashes, np.cumsum(counts)[:-1]))


def minima(shingle: np.ndarray) -> np.ndarray:
    out = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingle), 4096):
        out = np.minimum(out, (shingle[i : i + 4096, None] * MULTIPLY + ADD).min(axis=0))
    return out


def sketch(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the packed low bits of the minima, as int64."""
    m = minima(shingle)
    keys = series(4, BANDS)
    for row in m[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        keys = mix(keys + row)
    low = (mix(m) & _U(2**BITS - 1)).reshape(LANES, -1)
    packed = (low << (np.arange(low.shape[1], dtype=np.uint64) * _U(BITS))).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set), bands, signature of each row; one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, packed = [], [], [], []
            for s in sets(column(batch, "text"), k):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                b, p = sketch(s) if len(s) else (None, None)
                bands.append(b)
                packed.append(p)
            arrays = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *arrays], ["doc_id", "n_shingles", "key", "bands", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, key binary, bands array<bigint>, signature array<bigint>")


def sets_of(docs: DataFrame, needs: DataFrame, k: int) -> DataFrame:
    """task, v, c, head, shingles of each row of needs (task, v, c, head): a text is read and hashed once, its set goes to each task."""
    by_v = written(needs.groupBy("v").agg(F.collect_list("task").alias("tasks"), F.collect_list("head").alias("heads"), F.first("c").alias("c")))
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, c = column(batch, "doc_id"), column(batch, "c")
            for i, s in enumerate(sets(column(batch, "text"), k)):
                tasks, heads = column(batch, "tasks")[i].values, column(batch, "heads")[i].values
                step = max(1, PIECE // (8 * len(s) + 8))
                for j in range(0, len(tasks), step):
                    n = min(step, len(tasks) - j)
                    shingle = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(s)), pa.array(np.tile(s.view(np.int64), n)))
                    same = [pa.array(np.full(n, x[i].as_py(), np.int64)) for x in (v, c)]
                    yield pa.RecordBatch.from_arrays([tasks.slice(j, n), *same, heads.slice(j, n), shingle.cast(kind)], ["task", "v", "c", "head", "shingles"])

    ids = written(by_v.select("v"))
    asked = docs.join(few(ids), docs["doc_id"] == ids["v"], "left_semi")
    met = asked.join(by_v, asked["doc_id"] == by_v["v"]).select("doc_id", "text", "c", "tasks", "heads")
    return met.mapInArrow(run, "task bigint, v bigint, c bigint, head boolean, shingles array<bigint>")


def in_groups(df: DataFrame, one: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], lists: str, names: tuple[str, str]) -> DataFrame:
    """What one(columns, offsets, values) returns for the rows of each task: two columns of longs. lists: the column of arrays."""
    flats = [c for c in df.columns if c != lists]

    def cut(table: pa.Table, whole: bool) -> Iterator[tuple[int, int, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
        arrays = {c: table.column(c).to_numpy() for c in flats}
        many = table.column(lists).combine_chunks()
        many = many.chunk(0) if isinstance(many, pa.ChunkedArray) else many
        offsets, values = many.offsets.to_numpy(), many.values.to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(np.diff(arrays["task"])) + 1).tolist(), *([len(table)] if whole else [])]
        for start, end in zip([0, *ends], ends, strict=False):
            yield start, end, {c: x[start:end] for c, x in arrays.items()}, offsets[start : end + 1] - offsets[start], values[offsets[start] : offsets[end]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            parts = [*([held] if held is not None else []), *([pa.Table.from_batches([batch])] if batch is not None else [])]
            if not parts:
                return
            table, done, found = pa.concat_tables(parts).combine_chunks(), 0, []
            if not len(table):
                continue
            for _, end, columns, offsets, values in cut(table, batch is None):
                done = end
                if len(columns["task"]) > 1:
                    found.append(one(columns, offsets, values))
            held = table.slice(done)
            for x, y in [tuple(map(np.concatenate, zip(*found, strict=True)))] if found else []:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], list(names))

    return df.repartition("task").sortWithinPartitions("task").mapInArrow(run, f"{names[0]} bigint, {names[1]} bigint")


def drivers(c: np.ndarray) -> np.ndarray:
    """Members outside the most frequent component: one end of each pair that isn't in one component."""
    names, counts = np.unique(c, return_counts=True)
    return np.flatnonzero(c != names[counts.argmax()])


def with_partner(percent: int) -> Callable:
    """task, v of the members that have a likely partner in another component, by their signatures."""
    ones, chance = _U(int("1" * 16, 16)), 2.0**-BITS
    least = percent / 100 - MARGIN

    def one(columns: dict[str, np.ndarray], offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, n, lanes = columns["c"], columns["n"], values.view(np.uint64).reshape(-1, LANES)
        has = np.zeros(len(c), bool)
        for i in drivers(c):
            other = np.flatnonzero((c != c[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            x = lanes[other] ^ lanes[i]
            x |= (x >> _U(1)) | (x >> _U(2)) | (x >> _U(3))
            equal = 1 - np.bitwise_count(x & ones).sum(axis=1) / PERMUTATIONS
            near = other[(equal - chance) / (1 - chance) >= least]
            has[near] = True
            has[i] |= len(near) > 0
        return columns["task"][has], columns["v"][has]

    return one


def joined(percent: int) -> Callable:
    """a, b of links on full sets, none between members that are joined already; with heads, only links of those."""

    def one(columns: dict[str, np.ndarray], offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v, label, size = columns["v"], columns["c"].copy(), np.diff(offsets)
        _, shingle, times = np.unique(values, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(v)), size)[np.argsort(shingle, kind="stable")]
        first = np.cumsum(times) - times
        a, b = [], []
        heads = columns["head"].astype(bool)
        for i in np.flatnonzero(heads) if heads.any() else drivers(label):
            own = shingle[offsets[i] : offsets[i + 1]]
            count = times[own]
            at = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(v))
            near = np.flatnonzero((100 * both >= percent * (size[i] + size - both)) & (label != label[i]))
            for j in near[np.unique(label[near], return_index=True)[1]]:
                a.append(v[i])
                b.append(v[j])
            label[np.isin(label, label[near])] = label[i]
        return np.array(a, np.int64), np.array(b, np.int64)

    return one


def estimate(a: str, b: str) -> Column:
    """Similarity of two signatures: equal low bits, less what chance makes equal."""
    ones = F.lit(int("1" * 16, 16))
    unequal = F.lit(0)
    for i in range(LANES):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        unequal = unequal + F.bit_count(any_bit.bitwiseAND(ones))
    equal, chance = 1 - unequal / F.lit(PERMUTATIONS), 2.0**-BITS
    return (equal - chance) / (1 - chance)


def components(links: DataFrame) -> DataFrame:
    """v, c of each end of links (a, b): c is the smallest vertex reachable. Labels spread to neighbours and jump until none changes."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c"))
    labels = written(labels)
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("c").alias("m"))
        spread = labels.join(near, labels["v"] == near["a"]).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        top = labels.select(F.col("v").alias("t"), F.col("c").alias("of_top"))
        moved = written(spread.join(top, spread["c"] == top["t"]).select("v", "old", F.least("c", "of_top").alias("c")))
        changed = moved.filter("c < old").limit(1).count()
        labels = moved.select("v", "c")
        if not changed:
            return labels


def find(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; links have 100 * intersection >= percent * union."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    rows = written(sketches(texts, k))
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    named = written(rows.filter(linked).groupBy("key").agg(F.min("doc_id").alias("v"), F.count("*").alias("met"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    members = named.select("v", "n", F.explode("bands").alias("bucket"))
    blocks = F.ceil(F.greatest(F.col("met") / BLOCK_ROWS, F.col("size") / BLOCK_SHINGLES)).cast("int")
    shared = members.groupBy("bucket").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("met"), F.sum("n").alias("size")).filter("first < last")
    shared = written(shared.select("bucket", "first", blocks.alias("blocks"), "met"))
    alive = written(matched(members, shared, ["bucket"]).filter("v <> first").select("bucket", "v", "first", "blocks"))

    # Each member of a bucket with its first.
    side = lambda x: named.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    pairs = alive.select(F.col("first").alias("a"), F.col("v").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    near = pairs.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).filter(estimate("sa", "sb") >= percent / 100 - MARGIN)
    near = written(near.select("a", "b", "na", "nb"))
    load = near.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("nb") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = near.join(load, "a").withColumn("task", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("blocks"))))
    stars = dealt.select("task", F.col("b").alias("v"), F.col("b").alias("c"), F.lit(False).alias("head"))
    stars = stars.union(dealt.select("task", F.col("a").alias("v"), F.col("a").alias("c"), F.lit(True).alias("head")).distinct())
    labels = components(written(in_groups(sets_of(texts, stars, k), joined(percent), "shingles", ("a", "b"))))

    # The other members of buckets that still hold several components, block by block.
    of = written(alive.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v")))
    several = written(of.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("met")).filter("lo < hi").select("bucket", "met"))
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.xxhash64("bucket", F.least(own, y), F.greatest(own, y)))
    open_ = matched(of, several, ["bucket"]).select("v", "c", F.explode(meets).alias("task"))
    open_ = open_.join(named.select("v", "n", "signature"), "v").select("task", "v", "c", "n", "signature")
    likely = written(in_groups(open_, with_partner(percent), "signature", ("task", "v")).join(labels, "v", "left").select("task", "v", F.coalesce("c", "v").alias("c"), F.lit(False).alias("head")))
    more = in_groups(sets_of(texts, likely, k), joined(percent), "shingles", ("a", "b"))
    name = lambda x: labels.select(F.col("v").alias(x), F.col("c").alias(f"c{x}"))
    more = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    tops = components(written(more.filter("a <> b").distinct())).select(F.col("v").alias("c"), F.col("c").alias("top"))

    classes = named.select("key", "met", "v").join(labels, "v", "left").withColumn("c", F.coalesce("c", "v")).join(tops, "c", "left")
    classes = written(classes.select("key", "met", F.coalesce("top", "c").alias("component_id")))
    dropped(shared, alive, near, of, several, likely, named)
    found = matched(rows.filter(linked).select("doc_id", "n_shingles", "key"), classes, ["key"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
