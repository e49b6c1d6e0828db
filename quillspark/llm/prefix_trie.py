"""The trie of conversations by their turns, with a count-min sketch that finds prefixes of one conversation only.

Turns are sorted by conversation and place once; from there on each turn is a digest, and the digest of a prefix is the
exclusive or of the digests of its (depth, turn) pairs. Each task counts its prefixes in a count-min sketch; the merged sketch
never counts too few, so an estimate of one proves that a prefix has one conversation. Below such a prefix every node is
known where its turn is: these tails are emitted by the tasks that hold them. Only prefixes that may be shared are
shuffled and grouped exactly, with their parents, children and ends.

Sums over subtrees need no walk by levels. The smallest member of a node owns its value; the sum over a subtree is the
sum over its members of what each of them owns from that depth on.

A conversation may span tasks: places, digests and sums are made by parts of the sort order and carried from part to part. The
sketch has CELLS cells a turn, MOST_CELLS at most in each of its ROWS rows, of which the driver and each task hold a bit; on
more turns it proves less, and more is grouped.

Defined results: rows without conv_id are left out; null roles and texts are empty; turns are in the order of turn (null
first), role, text, so that equal rows all count; for a negative conv_id c, c % 20 has the sign of c, as in SQL; an empty
table gives no rows, not even a root; other columns are ignored. The ids of the conversations that end at a node pass in order
through one task, as a digest of them must; none is held there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, dropped, matched, written

#: Conversations of a family, whose first turns are those of its first one; a conversation takes under HEADS of these.
FAMILY, HEADS = 20, 4
#: The sketch: rows, cells a turn, the least and most cells of a row, cells of a slice.
ROWS, CELLS, LEAST_CELLS, MOST_CELLS, SLICE = 3, 4, 1 << 14, 1 << 24, 1 << 14
#: Bits of a place that count the rows of a part.
PART = 33
EMPTY = hashlib.sha256().hexdigest()
LOCAL, HEAD, SHARED = 0, 1, 2


def running(rows: DataFrame, values: dict[str, Column], how: Callable[[str], Column], join: Callable[[Column, Column], Column], reverse: bool = False) -> DataFrame:
    """rows (a table, with conv_id and at, its place over all rows) with the values added up over the rows of the conversation up to
    each one (from the last one, if reverse). Only conversations at the edges of parts need what other parts hold."""
    rows = rows.withColumns(values | {"part": F.shiftright("at", PART)})
    order = (F.col("at"), F.col("part")) if not reverse else (F.desc("at"), F.desc("part"))
    own = Window.partitionBy("conv_id", "part").orderBy(order[0]).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"))
    edges = F.broadcast(ends.select(F.explode(F.array("a", "b")).alias("conv_id")).distinct())  # two for each part
    totals = rows.join(edges, "conv_id", "left_semi").groupBy("conv_id", "part").agg(*(how(k).alias(k) for k in values))
    earlier = Window.partitionBy("conv_id").orderBy(order[1]).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "part", *(how(k).over(earlier).alias(f"{k}_before") for k in values))
    out = rows.withColumns({k: how(k).over(own) for k in values}).join(F.broadcast(before), ["conv_id", "part"], "left")
    added = {k: F.when(F.col(f"{k}_before").isNull(), F.col(k)).otherwise(join(F.col(k), F.col(f"{k}_before"))) for k in values}
    return out.withColumns(added).drop("part", *(f"{k}_before" for k in values))


def plus(a: Column, b: Column) -> Column:
    return a + b


def turns(conversations: DataFrame) -> DataFrame:
    """A table of conv_id, at (increasing in the order of all turns), t1, t2 (digest of role and text), words."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("copy"))
    ordered = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text", "copy")  # copy deals equal rows to several tasks
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    number = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")  # noqa: E731
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    out = ordered.withColumns({"digest": digest, "at": F.monotonically_increasing_id() + HEADS})
    return written(out.select("conv_id", "at", number(1).alias("t1"), number(16).alias("t2"), words.alias("words")))


def rebuilt(conversations: DataFrame, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Tables: the turns of conversations as rebuilt (conv_id, at, depth, t1, t2, words, n, their number), and conversations (conv_id, at, n)."""
    rows = turns(conversations)
    placed = written(running(rows, {"place": F.lit(1).cast("long")}, F.sum, plus))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = placed.groupBy("conv_id").agg(F.count("*").alias("met"), F.min("at").alias("first")).withColumns({"h": taken, "base": F.col("conv_id") - F.col("conv_id") % family})
    own = written(own)
    bases = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("met").alias("there"))
    m = F.least("h", F.coalesce("there", F.lit(0)))
    known = written(own.join(bases, "base", "left").withColumn("m", m).withColumn("n", F.col("m") + F.greatest(F.col("met") - F.col("h"), F.lit(0))).drop("there"))
    first = placed.filter((F.col("conv_id") % family == 0) & (F.col("place") < HEADS)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "t1", "t2", "words")
    heads = known.join(first, "base").filter(F.col("depth") <= F.col("h")).withColumn("at", F.col("first") - HEADS + F.col("depth"))
    rest = matched(placed, known.select("conv_id", "met", "h", "m", "n"), ["conv_id"]).filter(F.col("place") > F.col("h"))
    rest = rest.withColumn("depth", F.col("place") - F.col("h") + F.col("m"))
    names = ["conv_id", "at", "depth", "t1", "t2", "words", "n"]
    out = written(rest.select(*names).unionByName(heads.select(*names)))
    return out, known.select("conv_id", (F.col("first") - HEADS).alias("at"), "n")


def prefixes(rebuilt_turns: DataFrame) -> DataFrame:
    """A table with p1, p2, the digest of the prefix that ends with the turn, and q1, q2, that of its parent (0, 0 for the root)."""
    e1, e2 = F.xxhash64("t1", "t2", "depth"), F.xxhash64("depth", F.lit(1), "t2", "t1")
    both = lambda a, b: a.bitwiseXOR(b)  # noqa: E731
    summed = running(rebuilt_turns, {"p1": e1, "p2": e2}, F.bit_xor, both)
    return written(summed.withColumns({"q1": both(F.col("p1"), e1), "q2": both(F.col("p2"), e2)}).drop("t1", "t2"))


def cells(a: np.ndarray, b: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each digest in each row of the sketch; width is a power of two."""
    a, b = a.astype(np.uint64), b.astype(np.uint64) | np.uint64(1)
    return [(a + np.uint64(r) * b) >> np.uint64(64 - width.bit_length() + 1) for r in range(ROWS)]


def sketched(table: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """Whether each cell of a count-min sketch of (p1, p2) has counted two or more, a row of bits for each row of the sketch; its width."""
    width = min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS * count - 1).bit_length()))
    slices = width // SLICE

    def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((ROWS, width), np.uint8)  # counts up to 2
        for batch in batches:
            for row, cell in zip(seen, cells(column(batch, "p1").to_numpy(), column(batch, "p2").to_numpy(), width), strict=True):
                which, n = np.unique(cell, return_counts=True)
                row[which] = np.minimum(row[which] + np.minimum(n, 2), 2)
        for k, part in enumerate(seen.reshape(ROWS * slices, SLICE)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(part, 1)], pa.binary())], ["slice", "cells"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLICE, np.uint8)
        for batch in batches:
            for part in column(batch, "cells"):
                total = np.minimum(total + np.frombuffer(zlib.decompress(part.as_py()), np.uint8), 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(total > 1).tobytes()], pa.binary())], ["slice", "cells"])

    parts = table.select("p1", "p2").mapInArrow(count_task, "slice long, cells binary")
    bits = np.zeros((ROWS * slices, SLICE // 8), np.uint8)
    for r in parts.groupBy("slice").applyInArrow(merge, "slice long, cells binary").toLocalIterator():  # ROWS * MOST_CELLS bits at most
        bits[r["slice"]] = np.frombuffer(r["cells"], np.uint8)
    return bits.reshape(ROWS, width // 8), width


def screened(table: DataFrame, count: int) -> DataFrame:
    """table with kind: LOCAL if the parent is proven to have one conversation, else HEAD if the prefix is, else SHARED."""
    bits, width = sketched(table, count)
    shared = table.sparkSession.sparkContext.broadcast(bits)
    names = table.columns

    def single(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for row, cell in zip(shared.value, cells(a, b, width), strict=True):
            cell = cell.astype(np.int64)
            out |= row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 == 0
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, q1, q2, depth = (column(batch, c).to_numpy() for c in ("p1", "p2", "q1", "q2", "depth"))
            kind = np.where(single(q1, q2) & (depth > 1), LOCAL, np.where(single(p1, p2), HEAD, SHARED))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(kind)], [*names, "kind"])

    return written(table.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in table.dtypes) + ", kind long"))


def ends(rows: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256: the digest of the conv_ids of each node's rows, in order. They stream through it, sorted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], ["p1", "p2", "ends_sha256"])  # noqa: E731
        for batch in batches:
            p1, p2, ids = (column(batch, c).to_numpy() for c in ("p1", "p2", "conv_id"))
            cuts = np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if a == b:
                    continue
                mine = (int(p1[a]), int(p2[a]))
                if node is not None and node != mine:
                    yield row()
                    digest = hashlib.sha256()
                digest.update((b"," if node == mine else b"") + ",".join(map(str, ids[a:b].tolist())).encode())
                node = mine
        if node is not None:
            yield row()

    return rows.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "conv_id").select("p1", "p2", "conv_id").mapInArrow(run, "p1 long, p2 long, ends_sha256 string")


def trie(conversations: DataFrame, family: int = FAMILY) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turned, convs = rebuilt(conversations, family)
    prefixed = prefixes(turned)
    known = screened(prefixed, turned.count())
    dropped(turned, prefixed)
    node, above = ["p1", "p2"], ["q1", "q2"]
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    single = known.filter(F.col("kind") != SHARED)
    shared = written(known.filter(F.col("kind") == SHARED).drop("kind").unionByName(convs.withColumns(dict.fromkeys(["depth", "words", *node, *above], zero))))
    first = [F.max(k).alias(k) for k in ("depth", "words", *above)]  # equal in all rows of a node
    groups = written(shared.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n").alias("deepest"), *first))

    # what each conversation owns: the value of the nodes whose smallest member it is, and the leaf at its end
    rows = matched(shared, groups.select(*node, F.col("conv_id").alias("owner"), "deepest", "n_convs", F.col("n_convs").alias("met")), node)
    own = F.col("owner") == F.col("conv_id")
    saved, leaf = (F.col("n_convs") - 1) * F.col("words"), (F.col("depth") == F.col("n")) & (F.col("deepest") == F.col("n"))
    owned = rows.select("conv_id", "at", *node, F.when(own, saved).otherwise(zero).alias("saved"), (own & leaf).cast("long").alias("leaves"))
    tails = single.filter("depth = n").select("conv_id", "at", nothing.alias("p1"), nothing.alias("p2"), zero.alias("saved"), (zero + 1).alias("leaves"))
    owned = written(owned.unionByName(tails))
    further = running(owned, {k: F.col(k) for k in ("saved", "leaves")}, F.sum, plus, reverse=True).filter("p1 IS NOT NULL")
    sums = further.groupBy(*node).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    parents = [F.col(q).alias(p) for p, q in zip(node, above, strict=True)]
    heads = single.filter(F.col("kind") == HEAD)
    children = groups.filter("depth > 0").select(*parents).unionByName(heads.select(*parents)).groupBy(*node).agg(F.count("*").alias("n_children"))
    ended = ends(shared.filter("depth = n"))
    nodes = written(groups.join(sums, node).join(children, node, "left").join(ended, node, "left").fillna({"n_children": 0, "ends_sha256": EMPTY}))

    # a prefix that isn't proven to be single may stand below one that is; its parent then is of the same conversation
    met = nodes.filter("n_children > 0").select(*(F.col(p).alias(q) for p, q in zip(node, above, strict=True)), F.col("conv_id").alias("above"), F.col("n_children").alias("met"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    fixed = {"n_convs": zero + 1, "n_leaves": zero + 1, "saved_tokens": zero, "n_children": (F.col("depth") < F.col("n")).cast("long")}
    digest = F.when(F.col("depth") == F.col("n"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY)
    emitted = lambda rows: rows.withColumns(fixed | {"ends_sha256": digest})  # noqa: E731
    below = nodes.filter("depth > 0").select(*above, *(c for c in columns if c != "parent_conv_id")).unionByName(emitted(heads).select(*above, *(c for c in columns if c != "parent_conv_id")))
    placed = matched(below, met, above, how="left").withColumn("parent_conv_id", F.coalesce("above", "conv_id"))
    root = nodes.filter("depth = 0").withColumn("parent_conv_id", nothing)
    local = emitted(single.filter(F.col("kind") == LOCAL)).withColumn("parent_conv_id", F.col("conv_id"))
    return placed.select(*columns).unionByName(root.select(*columns)).unionByName(local.select(*columns))


#: The same nodes, with each prefix as its whole text.
ORACLE = r"""
WITH steps AS (
  SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
  FROM (SELECT cast(range AS BIGINT) AS i FROM range(256))),
crc AS (SELECT list(v ORDER BY i) AS v FROM steps),
r AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(cast(conv_id AS VARCHAR), ''), lambda s: cast(ascii(s) AS BIGINT)),
      lambda x, b: xor(x >> 8, v[xor(x & 255, b) + 1])), 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base
  FROM (SELECT DISTINCT conv_id FROM r), crc),
t AS (
  SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN r ON r.conv_id = base AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN r ON r.conv_id = c.conv_id AND place > h),
d AS (
  SELECT conv_id, row_number() OVER w AS depth, len(list_filter(regexp_split_to_array(text, '[ 	-]+'), lambda x: x <> '')) AS words,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node, max(depth) OVER (PARTITION BY conv_id) AS n FROM d),
n AS (
  SELECT node, depth, count(*) AS n_convs, max(n) AS deepest, any_value(words) AS words,
    sha256(coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM m GROUP BY node, depth),
p AS (SELECT a.node, a.depth, any_value(b.node) AS parent FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1 GROUP BY a.node, a.depth),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS children FROM p WHERE parent IS NOT NULL GROUP BY parent, depth),
s AS (
  SELECT m.node, m.depth, sum((x.n_convs - 1) * x.words) AS saved, count(*) FILTER (x.deepest = x.depth) AS leaves
  FROM m JOIN n x ON x.node = m.conv_id AND x.depth >= m.depth GROUP BY m.node, m.depth)
SELECT n.node AS conv_id, n.depth, p.parent AS parent_conv_id, n.n_convs, coalesce(k.children, 0) AS n_children, s.leaves AS n_leaves,
  cast(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN p ON p.node = n.node AND p.depth = n.depth JOIN s ON s.node = n.node AND s.depth = n.depth
  LEFT JOIN k ON k.node = n.node AND k.depth = n.depth
"""
