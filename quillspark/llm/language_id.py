"""Language identification: nearest of several centroids per language over TF-IDF n-gram vectors.

A text's vector counts hashed character trigrams of its lower-cased letters (runs of other characters are one
blank), damped by a logarithm, weighted by inverse document frequency and scaled to length 1. Each language has up
to CENTROIDS centroids, by spherical k-means over its share of a sample of training documents: FIT_ROWS over all languages,
but LEAST_ROWS of each language at least (or all it has), so that every language of the training folds can be predicted. A
document gets the language of the centroid of largest cosine; where that cosine is below the threshold that
rejects REJECT of the training sample, accepted is false (the nearest language is still reported).

Defined results: null texts and texts without a letter are `und` with score 0 and not accepted, as is every text
when nothing can be learned; repeated rows get equal results; a null doc_id never trains; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, column, fold, held_out, matched, small_batches, written

#: Bound of the training sample over all languages, and what each language may have however many there are.
FIT_ROWS, LEAST_ROWS = 6000, 20
DIMENSIONS = 2048
CENTROIDS = 3
REJECT = 0.002
#: Code points handled at a time.
PIECE = 1 << 20

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts [text, DIMENSIONS], and whether a text has a letter."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    n = len(texts)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(n), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    out, lettered = np.zeros(n * DIMENSIONS, np.int64), np.zeros(n, bool)
    for i in range(0, len(points), PIECE):
        part = slice(max(0, i - 2), i + PIECE)  # trigrams may span two pieces
        p, d = points[part], doc[part]
        letter = _is_letter()[p]
        lettered[d[letter]] = True
        p = np.where(letter, p, 32).astype(np.uint64)
        keep = np.ones(len(p), bool)
        keep[1:] = letter[1:] | letter[:-1] | (d[1:] != d[:-1])
        p, d = p[keep], d[keep]
        h = p[:-2] * np.uint64(0x9E3779B97F4A7C15) + p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:] * np.uint64(0x165667B19E3779F9)
        slot = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 11)).astype(np.int64)
        same = (d[:-2] == d[2:]) & (p[1:-1] != 32)
        out += np.bincount(d[:-2][same] * DIMENSIONS + slot[same], minlength=n * DIMENSIONS)
    return out.reshape(n, DIMENSIONS), lettered


@dataclass(frozen=True)
class Centroids:
    idf: np.ndarray
    centroid: np.ndarray
    lang: tuple[str, ...]
    threshold: float


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def cluster(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; seeds are spread evenly over the order of similarity to the mean, so that no outlier is one."""
    near = np.argsort(v @ v.mean(axis=0), kind="stable")
    c = v[near[(np.arange(min(k, len(v))) + 0.5).astype(int) if len(v) <= k else ((np.arange(k) + 0.5) * len(v) / k).astype(int)]]
    for _ in range(rounds):
        of = (v @ c.T).argmax(axis=1)
        c = np.stack([v[of == j].mean(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.minimum(r, 65535).astype(np.uint16).tobytes() for part in chunks(column(batch, "text"), rows=128) for r in counts(part)[0]]
        yield pa.RecordBatch.from_arrays([column(batch, "lang"), column(batch, "h"), pa.array(rows, pa.binary())], ["lang", "h", "x"])


def train(docs: DataFrame, rows: int = FIT_ROWS, least: int = LEAST_ROWS) -> Centroids:
    """Learn from an equal number of documents of each language, those first by a hash of id and text; equal rows count once."""
    small_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & (fold("doc_id") != 0) & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("n"), F.count("*").alias("met")))
    kinds = sizes.count()
    if not kinds:
        return Centroids(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), (), 0.0)
    share = max(least, rows // kinds)
    # the hash thins each language to about twice its share, so that no task ranks a whole language
    hashed = known.withColumn("h", F.xxhash64("doc_id", "text"))
    thin = matched(hashed, sizes, ["lang"]).filter(F.pmod("h", F.lit(1 << 30)) < (1 << 30) * F.lit(2.0 * share) / F.col("n"))
    once = thin.groupBy("lang", "h").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = once.withColumn("place", place).filter(F.col("place") <= share).select("lang", "h", "text").mapInArrow(_count, "lang string, h bigint, x binary").toArrow()
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.uint16).reshape(-1, DIMENSIONS)
    lang = np.array(sample["lang"].to_pylist(), object)
    order = np.lexsort([sample["h"].to_numpy(), np.unique(lang.astype(str), return_inverse=True)[1]])
    x, lang = x[order], lang[order]
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    v = vectors(x, idf)
    parts = {k: cluster(v[lang == k], CENTROIDS) for k in sorted(set(lang))}
    centroid = np.concatenate(list(parts.values()))
    near = np.concatenate([(v[i : i + 1024] @ centroid.T).max(axis=1) for i in range(0, len(v), 1024)])
    near = near[near > 0]
    return Centroids(idf, centroid, tuple(k for k, c in parts.items() for _ in c), float(np.quantile(near, REJECT)) if len(near) else 0.0)


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score (cosine), accepted for each row of docs; one pass without a shuffle."""
    small_batches(docs.sparkSession)
    names = np.array([*model.lang, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, cosine = [np.empty(0, np.int64)], [np.empty(0)]
            for part in chunks(column(batch, "text"), rows=128):
                count, lettered = counts(part)
                if len(model.lang):
                    c = vectors(count, model.idf) @ model.centroid.T
                    best.append(np.where(lettered, c.argmax(axis=1), len(model.lang)))
                    cosine.append(np.where(lettered, np.clip(c.max(axis=1), 0, 1), 0).astype(float))
                else:
                    best.append(np.zeros(len(part), np.int64))
                    cosine.append(np.zeros(len(part)))
            of, cos = np.concatenate(best), np.concatenate(cosine)
            lang = names[of]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(lang, pa.string()), pa.array(cos), pa.array((cos >= model.threshold) & (lang != "und"))], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean")


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, with a model learned from the training folds of docs."""
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
