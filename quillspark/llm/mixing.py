"""Mixing sources to target weights by iterative proportional fitting.

Documents get a topic and a token weight (a column of the caller's, else a quarter of their bytes, rounded up; encoding
all texts only to count them would cost several times the rest). Tokens are summed by (source, language, topic). Raking
gives each source, language and topic a factor, so that the kept tokens of each meet its target: a document is kept with
probability min(1, product of its three factors), by a hash of its id, so that the same documents stay in every run.
Probabilities are cut at 1 while raking, not after it, so what full cells can't give is made up by the other cells of
the same margin. A target beyond all tokens of its name becomes these, and the other names of the margin share the rest;
mix() warns of that, and margins() shows what was kept.

Topics are the nearest of TOPICS centroids over TF-IDF n-gram vectors. Document frequencies are counted on all documents;
centroids start from at most FIT_ROWS documents, and each of PASSES passes moves them to the mean of all documents that
are nearest to them.

Every source, language and topic has its own margin. A table of at most CELLS cells is raked on the driver, a larger one
on Spark.

Defined results: a null source or language is a name of its own, beside the empty one; a null text has no tokens; rows with
equal doc_id (so all with a null one) share one draw and stay or go together if their cells agree; cells without tokens
keep probability 1; an empty table gives no rows; columns of the caller's keep any name.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, column, dropped, extended, matched, small_batches, written
from .language_id import DIMENSIONS, cluster, counts, vectors

TOPICS = 8
#: Cells that the driver takes, at most.
CELLS = 65_536
#: Bound of the sample that centroids of topics start from, and how often all documents move them.
FIT_ROWS, PASSES = 2000, 1
#: Without targets of the caller's, they are the shares of tokens to this power; and the share of all tokens to keep.
TEMPER = 0.7
KEEP = 0.8
#: Raking ends when no margin is off by more than this share of its target, or after so many rounds.
TOLERANCE, ROUNDS = 1e-6, 500
#: Factors stay below this, which only those of targets beyond all their tokens reach.
MOST = 1e9

NAMES = ("source", "lang", "topic")


@dataclass(frozen=True)
class Topics:
    idf: np.ndarray
    centroid: np.ndarray

    def nearest(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of texts, and the place of the centroid nearest to each."""
        v = vectors(counts(part)[0], self.idf)
        return v, (v @ self.centroid.T).argmax(axis=1) if len(self.centroid) else np.zeros(len(part), np.int64)


def _idf(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all rows of docs; the driver gets one vector from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, having = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for part in chunks(column(batch, "text"), rows=128):
                n, having = n + len(part), having + (counts(part)[0] > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([having.tolist()], pa.list_(pa.int64()))], ["n", "having"])

    rows = docs.select("text").mapInArrow(run, "n bigint, having array<bigint>")
    sums = rows.select("n", F.posexplode("having").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
    having = np.zeros(DIMENSIONS, np.int64)
    having[sums["i"].to_numpy()] = sums["x"].to_numpy()
    return np.log((1 + max(sums["n"].to_pylist(), default=0)) / (1 + having)).astype(np.float32)


def _moved(docs: DataFrame, topics: Topics) -> Topics:
    """Each centroid at the mean of all documents that are nearest to it; sums of the tasks are added on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(topics.centroid.shape)
        for batch in batches:
            for part in chunks(column(batch, "text"), rows=128):
                v, near = topics.nearest(part)
                for j in np.unique(near):
                    sums[j] += v[near == j].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([np.round(s * 2**20).astype(np.int64).tolist() for s in sums], pa.list_(pa.int64()))], ["j", "s"])

    # sums of whole numbers don't depend on the order of the tasks
    sums = docs.select("text").mapInArrow(run, "j int, s array<bigint>").select("j", F.posexplode("s").alias("i", "x")).groupBy("j", "i").agg(F.sum("x").alias("x")).toArrow()
    c = np.zeros(topics.centroid.shape)
    c[sums["j"].to_numpy(), sums["i"].to_numpy()] = sums["x"].to_numpy()
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return Topics(topics.idf, np.where(norm > 0, c / np.maximum(norm, 1e-9), topics.centroid).astype(np.float32))


def learn_topics(docs: DataFrame, rows: int = FIT_ROWS, passes: int = PASSES) -> Topics:
    small_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id", F.lit(7)), "id").limit(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.minimum(r, 65535).astype(np.uint16).tobytes() for part in chunks(column(batch, "text"), rows=128) for r in counts(part)[0]]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(out, pa.binary())], ["id", "x"])

    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("id", "text").mapInArrow(count, "id bigint, x binary").groupBy("id").agg(F.max("x").alias("x")).toArrow().sort_by("id")
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.uint16).reshape(-1, DIMENSIONS)
    idf = _idf(docs)
    topics = Topics(idf, cluster(vectors(x, idf), TOPICS) if len(x) else np.zeros((0, DIMENSIONS), np.float32))
    for _ in range(passes if len(x) else 0):
        topics = _moved(docs, topics)
    return topics


def with_topic(docs: DataFrame, topics: Topics, tokens: Column | None = None) -> DataFrame:
    """document (a struct of the columns of docs), doc_id, source, lang, tokens, topic of each row of docs; one pass without a shuffle."""
    small_batches(docs.sparkSession)
    size = tokens if tokens is not None else F.ceil(F.octet_length("text") / 4)
    packed = docs.select(F.struct(*docs.columns).alias("document"), "doc_id", "source", "lang", F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = column(batch, "document").field("text")
            found = [np.empty(0, np.int64), *(topics.nearest(part)[1] for part in chunks(text, rows=128))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found), pa.int32())], [*batch.schema.names, "topic"])

    return packed.mapInArrow(run, extended(packed, "topic int"))


def rake(tokens: np.ndarray, index: list[np.ndarray], target: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """The product of each cell's factors, such that the sums of tokens * min(1, product) by each index meet its target, and how
    far the worst margin is off (a share of its target)."""
    factor = [np.ones(len(t)) for t in target]
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for i, t, f in zip(index, target, factor, strict=True):
            product = np.prod([g[j] for g, j in zip(factor, index, strict=True)], axis=0)
            have = np.bincount(i, tokens * np.minimum(1, product), len(t))
            step = np.divide(t, have, out=np.ones(len(t)), where=have > 0)
            worst = max(worst, float(np.abs(step - 1).max(initial=0)))
            f *= step
            np.minimum(f, MOST, out=f)
        if worst < tolerance:
            break
    return np.prod([g[j] for g, j in zip(factor, index, strict=True)], axis=0), worst


def reachable(margin: DataFrame, goal: float, rounds: int = 50) -> tuple[DataFrame, float]:
    """margin (n: all tokens of a name, share: of the goal) with target = min(n, scale * share), scale such that targets sum to the
    goal, and the largest share of its target that a name lacks."""
    scale = goal
    for _ in range(rounds):
        target = F.least("n", F.col("share") * scale)
        have, rest, lack = margin.agg(F.sum(target), F.sum(F.when(target < F.col("n"), F.col("share"))), F.max(F.when(F.col("share") * goal > 0, 1 - F.col("n") / (F.col("share") * goal)))).first()
        if have is None or not rest or goal - have < 1e-9 * goal:
            break
        scale += (goal - have) / rest
    return margin.withColumn("target", F.least("n", F.col("share") * scale)), max(0.0, (lack or 0.0) if goal else 0.0)


def _rake_on_spark(cells: DataFrame, margins: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """rake() where neither the cells nor the names fit the driver: a table of factors for each of the three names."""
    factors = {c: written(margins[c].select(c, F.col("target").alias(f"target_{c}"), F.lit(1.0).alias(f"f_{c}"))) for c in NAMES}
    factor = lambda c: factors[c].select(c, f"f_{c}")
    product = F.col("f_source") * F.col("f_lang") * F.col("f_topic")
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for c in NAMES:
            whole = cells
            for k in NAMES:
                whole = whole.join(factor(k), k)
            have = whole.groupBy(c).agg(F.sum(F.col("n") * F.least(F.lit(1.0), product)).alias("have"))
            step = F.when(F.col("have") > 0, F.col(f"target_{c}") / F.col("have")).otherwise(1.0)
            new = written(factors[c].drop("off").join(have, c).select(c, f"target_{c}", F.least(F.lit(MOST), F.col(f"f_{c}") * step).alias(f"f_{c}"), F.abs(step - 1).alias("off")))
            worst = max(worst, new.agg(F.max("off")).first()[0])
            dropped(factors[c])
            factors[c] = new
        if worst < tolerance:
            break
    for c in NAMES:
        cells = cells.join(factor(c), c)
    return cells.withColumn("weight", product), worst


def _name(c: str) -> Column:
    """A source or language as text that tells null from any name."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def calibrate(topical: DataFrame, targets: dict[str, dict] | None = None, temper: float = TEMPER, keep: float = KEEP) -> DataFrame:
    """Cells (source, lang, topic, as names; met: their rows; weight, probability); topical: source, lang, tokens, topic.

    targets: for any of source, lang, topic the share of each name (None is null); names left out get the rest by their tempered shares.
    """
    spark = topical.sparkSession
    sums = written(topical.groupBy(_name("source").alias("source"), _name("lang").alias("lang"), "topic").agg(F.sum("tokens").cast("double").alias("n"), F.count("*").alias("met")))
    total = sums.agg(F.sum("n")).first()[0] or 0.0
    goal = keep * total
    given = {c: {(k if c == "topic" else "null" if k is None else f"={k}"): v for k, v in (targets or {}).get(c, {}).items()} for c in NAMES}
    margins, lacks = {}, {}
    for c in NAMES:
        known = spark.createDataFrame(list(given[c].items()), f"{c} {dict(sums.dtypes)[c]}, given double")
        sized = sums.groupBy(c).agg(F.sum("n").alias("n"))
        own = written(sized.withColumn("own", F.pow("n", F.lit(temper))).join(F.broadcast(known), c, "left"))  # what the caller gave
        fixed, rest = own.agg(F.coalesce(F.sum("given"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("given").isNull(), F.col("own"))), F.lit(0.0))).first()
        scale = max(0.0, 1 - fixed) / rest if rest else 0.0
        share = F.coalesce("given", F.col("own") * scale) / ((fixed + rest * scale) or 1.0)
        margins[c], lacks[c] = reachable(own.select(c, "n", share.alias("share")), goal)
    if sums.count() > CELLS:
        cells, worst = _rake_on_spark(sums, margins)
    else:
        rows = sums.orderBy(*NAMES).collect()
        index, target = [], []
        for c in NAMES:
            of = {r[c]: r["target"] for r in margins[c].collect()}
            names = {k: i for i, k in enumerate(of)}
            index.append(np.array([names[r[c]] for r in rows], np.int64))
            target.append(np.array(list(of.values())))
        weight, worst = rake(np.array([r["n"] for r in rows]), index, target) if rows else (np.zeros(0), 0.0)
        cells = spark.createDataFrame([(*(r[c] for c in NAMES), r["n"], r["met"], float(w)) for r, w in zip(rows, weight, strict=True)], "source string, lang string, topic int, n double, met bigint, weight double")
    for c, lack in lacks.items():
        if lack > 0.01:
            warnings.warn(f"mixture: all tokens of a {c} are {lack:.0%} short of its target, where {keep:.0%} of all are kept", stacklevel=2)
    if worst > 0.01:
        warnings.warn(f"mixture: a margin is off by {worst:.1%} of its target after {ROUNDS} rounds", stacklevel=2)
    return written(cells.select(*NAMES, "met", "weight", F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("weight"))).otherwise(1.0).alias("probability")))


def sample(topical: DataFrame, cells: DataFrame) -> DataFrame:
    """topical with weight, probability and kept."""
    placed = topical.withColumn("cell", F.struct(_name("source").alias("source"), _name("lang").alias("lang"), "topic"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    keyed = cells.select(F.struct(*NAMES).alias("cell"), "met", "weight", "probability")
    return matched(placed, keyed, ["cell"]).withColumn("kept", draw < F.col("probability")).drop("cell")


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP, tokens: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, kept for each row of docs."""
    topical = written(with_topic(docs.select("doc_id", "source", "lang", "text"), learn_topics(docs), tokens).drop("document"))
    return sample(topical, calibrate(topical, targets, keep=keep)).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "kept")


def margins(mixed: DataFrame) -> DataFrame:
    """margin, name, tokens, kept_tokens, share (of the kept tokens) for each source, language and topic of mix()."""
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("margin"), F.col(c).cast("string").alias("name")) for c in NAMES))).alias("m")
    each = mixed.select(one, "tokens", F.when(F.col("kept"), F.col("tokens")).otherwise(0).alias("stays"))
    sums = each.groupBy("m.margin", "m.name").agg(F.sum("tokens").alias("tokens"), F.sum("stays").alias("kept_tokens"))
    whole = sums.groupBy("margin").agg(F.sum("kept_tokens").alias("whole"))
    return sums.join(whole, "margin").select("margin", "name", "tokens", "kept_tokens", (F.col("kept_tokens") / F.col("whole")).alias("share"))


def kept_documents(docs: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of docs that the mixture keeps, with their columns."""
    topical = with_topic(docs, learn_topics(docs))
    narrow = written(topical.drop("document"))
    return sample(topical, calibrate(narrow, targets, keep=keep)).filter("kept").select("document.*")
