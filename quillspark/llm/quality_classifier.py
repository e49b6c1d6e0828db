"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Training takes at most FIT_ROWS labelled documents of the training folds (those first by a hash of the id); only
their statistics reach the driver. Scoring is one pass of Arrow batches over doc_id and text, without a shuffle.

Defined results: a null text counts as empty, an empty text is scored like any other; rows are scored one by one,
so repeated rows get equal scores; a null doc_id is not held out and never trains; of several labels of one
document the largest counts; without usable labels every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt, hashing
from .common import chunks, column, extended, flat, fold, held_out, small_batches

#: Bound of the training sample.
FIT_ROWS = 20_000
#: Scores from here on count as good quality.
THRESHOLD = 0.3
#: Bytes of a text from which its statistics are summed piece by piece (cut at blanks, so that sums and sets are those of the whole).
PIECE = 4 << 20

LOWER, UPPER, DIGIT, BLANK, NEWLINE, STOP, SYMBOL, MARK, LEAD, TAIL, CONTROL = range(11)
CLASSES = 16


def _classes() -> np.ndarray:
    table = np.full(256, CONTROL, np.int64)
    for kind, chars in ((LOWER, range(97, 123)), (UPPER, range(65, 91)), (DIGIT, range(48, 58)), (BLANK, b" \t\r\v\f"), (NEWLINE, b"\n"), (MARK, range(33, 48)), (MARK, range(58, 65)), (MARK, range(91, 97)), (MARK, range(123, 127)), (STOP, b".,;:!?'\"-()"), (SYMBOL, b"#*$%&|<>"), (TAIL, range(128, 192)), (LEAD, range(192, 256))):
        table[list(chars)] = kind
    return table


CLASS = _classes()
FEATURES = ("log_chars", "log_words", "word_mean", "word_std", "lower", "upper", "digit", "blank", "newline", "stop", "symbol", "mark", "non_ascii", "control", "doubled", "distinct_words", "repeated_lines", "line_words")


def _sums(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: counts by class of byte, words, their lengths, squares of these, and bytes like the one before."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), lengths)
    kind = CLASS[data]
    count = np.bincount(doc * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    space = (kind == BLANK) | (kind == NEWLINE)
    first = np.zeros(len(data), bool)
    first[offsets[:-1][lengths > 0]] = True
    start = ~space & (first | np.concatenate([[True], space[:-1]])) if len(data) else first
    end = np.append(start[1:] | space[1:] | first[1:], True) & ~space if len(data) else first
    at = np.flatnonzero(start)
    long = np.flatnonzero(end) - at + 1.0
    words, total, squares = (np.bincount(doc[at], w, n) for w in (None, long, long**2))
    doubled = np.bincount(doc[1:][(data[1:] == data[:-1]) & ~first[1:]], minlength=n) if len(data) > 1 else np.zeros(n)
    return np.column_stack([count, words, total, squares, doubled])


def statistics(texts: pa.Array) -> np.ndarray:
    """FEATURES of each text, float32."""
    data, offsets = flat(texts)
    n, lengths = len(texts), np.diff(offsets)
    if n == 1 and len(data) > PIECE:
        sums = sum(_sums(data[a:b], np.array([0, b - a])) for a, b in hashing.cuts(data, hashing.BLANKS, PIECE))
        sums[:, -1] = np.count_nonzero(data[1:] == data[:-1])  # pairs may span two pieces
    else:
        sums = _sums(data, offsets)
    count, (words, total, squares, doubled) = sums[:, :CLASSES], sums[:, CLASSES:].T
    mean = total / np.maximum(words, 1)
    chars = np.maximum(lengths - count[:, TAIL], 1)
    kinds, of_words = hashing.runs(data, offsets)
    lines, of_lines = hashing.runs(data, offsets, hashing.NEWLINES)
    fresh = hashing.distinct(kinds, of_words) / np.maximum(of_words, 1)
    again = np.where(of_lines > 0, 1 - hashing.distinct(lines, of_lines) / np.maximum(of_lines, 1), 0.0)
    out = [np.log1p(lengths), np.log1p(words), mean, np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean**2, 0))]
    out += [count[:, k] / chars for k in (LOWER, UPPER, DIGIT, BLANK, NEWLINE, STOP, SYMBOL, MARK, LEAD, CONTROL)]
    out += [doubled / chars, fresh, again, np.log1p(words / (count[:, NEWLINE] + 1))]
    return np.stack(out, axis=1).astype(np.float32)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "text")
        rows = [r.tobytes() for part in chunks(texts) for r in statistics(part)]
        yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "y"), pa.array(rows, pa.binary())], ["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = FIT_ROWS) -> gbt.Trees:
    """Fit on at most rows documents of the training folds that have a label; of several texts of one id, one counts."""
    small_batches(docs.sparkSession)
    picked = labels.filter(F.col(target).isNotNull() & (fold("doc_id") != 0)).groupBy(F.col("doc_id").alias("id")).agg(F.max(target).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("id", "y", "text")
    sample = chosen.mapInArrow(_measure, "id bigint, y int, x binary").groupBy("id").agg(F.max("y").alias("y"), F.max("x").alias("x")).toArrow()
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.float32).reshape(-1, len(FEATURES))
    y = sample["y"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # rows come in any order
    return gbt.fit(x[order], y[order])


def score(docs: DataFrame, model: gbt.Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and score; one row for each row of docs."""
    return scored(docs.select(F.struct(*dict.fromkeys([*keep, "text"])).alias("document")), model).select(*(F.col("document")[k].alias(k) for k in keep), "score")


def scored(documents: DataFrame, model: gbt.Trees) -> DataFrame:
    """documents (one column, document: a struct with text) with score. Other fields may have any name."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.predict(statistics(part)) for part in chunks(column(batch, "document").field("text"))]
            scores = pa.array(np.concatenate(parts) if parts else [], pa.float64())
            yield pa.RecordBatch.from_arrays([column(batch, "document"), scores], ["document", "score"])

    return documents.mapInArrow(run, extended(documents, "score double"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
