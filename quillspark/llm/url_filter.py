"""URL filters: rules by host and path, else gradient-boosted trees over lexical features.

The longest rule that fits decides; a URL without a fitting rule gets the verdict of trees trained on URLs that
have a verdict. Features: length, depth, digit ratio, entropy, parameter counts and how common the host's suffix
is among all pages. Training takes at most FIT_ROWS labelled URLs (first by a hash of the URL). Suffixes are counted on
all rows; counts of those that a COMMON-th of the rows has (COMMON at most) are broadcast, rarer ones are joined by sorting.

Defined results: a null URL, or one without ://, has an empty host and path and no rule; repeated rows get equal
results; without labelled URLs everything is allowed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import chunks, column, flat, small_batches, written

FIT_ROWS = 20_000
#: Suffixes whose counts are broadcast, at most; a key has 64 bytes at most.
COMMON = 16_384
BLOCK_FROM = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return pages.select("page_id", "url", F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))


def fitting(rules: dict[str, str]) -> Column:
    """The longest rule that fits host and path, or null. The rules are a parameter, tested one after the other."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def suffix() -> Column:
    """What follows the last dot of the host; its digest where that has over 63 bytes (no digest is as short as a suffix)."""
    last = F.substring_index("host", ".", -1)
    return F.when(F.octet_length(last) < 64, last).otherwise(F.sha2(last.cast("binary"), 256))


def with_counts(ruled: DataFrame, counts: DataFrame) -> DataFrame:
    """ruled with seen, the rows of its suffix: each suffix of less than a COMMON-th of the rows is sorted, so no task gets a hot one."""
    total = counts.agg(F.sum("seen")).first()[0] or 0
    common = F.col("seen") * COMMON >= total
    most = F.broadcast(counts.filter(common))
    if counts.filter(~common).isEmpty():
        return ruled.join(most, "suffix")
    rest = ruled.join(most, "suffix", "left_anti").join(counts.filter(~common).hint("merge"), "suffix")
    return ruled.join(most, "suffix").unionByName(rest)


def features(url: pa.Array, host: pa.Array, path: pa.Array, seen: np.ndarray) -> np.ndarray:
    """Lexical features of URLs; seen: how many pages have the suffix of each one's host."""
    data, offsets = flat(url)
    n, long = len(url), np.diff(offsets)
    count = np.bincount(np.repeat(np.arange(n), long) * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    share = count / np.maximum(long, 1)[:, None]
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(axis=1)
    of = lambda chars: count[:, list(chars)].sum(axis=1)
    hosts, paths = host.to_pylist(), path.to_pylist()
    own = np.array([(len(h), h.count("."), h.count("-"), len(p), p.count("/"), float("." in p.rpartition("/")[2]), max(map(len, h.split(".")))) for h, p in zip(hosts, paths, strict=True)], float).reshape(n, 7)
    digits = of(range(48, 58))
    out = [long, entropy, digits / np.maximum(long, 1), of(b"&") + of(b"?"), of(b"="), of(b"#"), of(b"-"), of(b"%"), of(range(65, 91)), *own.T, np.log1p(seen)]
    return np.stack(out, axis=1).astype(np.float32)


def train(labelled: DataFrame, counts: DataFrame, rows: int = FIT_ROWS) -> gbt.Trees:
    """From url, host, path, suffix, y (1: block) of at most rows URLs."""
    first = labelled.orderBy(F.xxhash64("url"), "url", "y").limit(rows)
    sample = first.join(counts, "suffix").select("url", "host", "path", "seen", "y").toArrow().combine_chunks()
    if not len(sample):
        return gbt.Trees(np.zeros((0, 15), np.int64), np.zeros((0, 15)), np.zeros((0, 16)), -9.0)
    text = lambda k: sample[k].combine_chunks() if isinstance(sample[k], pa.ChunkedArray) else sample[k]
    x = features(text("url"), text("host"), text("path"), sample["seen"].to_numpy().astype(float))
    y = sample["y"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])
    return gbt.fit(x[order], y[order])


def judge(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the trees: 1 is block) for each row of pages."""
    small_batches(pages.sparkSession)
    ruled = parts(pages).withColumn("rule", fitting(rules)).withColumn("suffix", suffix())
    counts = written(ruled.groupBy("suffix").agg(F.count("*").alias("seen")))
    verdict = F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))[F.col("rule")] if rules else F.lit(None).cast("string")
    model = train(ruled.filter(F.col("rule").isNotNull()).withColumn("y", (verdict == "block").cast("int")), counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, start = [np.empty(0)], 0
            host, path, seen = column(batch, "host"), column(batch, "path"), column(batch, "seen").to_numpy().astype(float)
            for part in chunks(column(batch, "url")):
                end = start + len(part)
                scores.append(model.predict(features(part, host.slice(start, len(part)), path.slice(start, len(part)), seen[start:end])))
                start = end
            names = ["page_id", "host", "path", "rule"]
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in names), pa.array(np.concatenate(scores))], [*names, "score"])

    scored = with_counts(ruled, counts).select("page_id", "host", "path", "rule", "url", "seen").mapInArrow(run, "page_id bigint, host string, path string, rule string, score double")
    own = F.when(F.col("score") >= BLOCK_FROM, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(verdict, own).alias("verdict"), "score")
