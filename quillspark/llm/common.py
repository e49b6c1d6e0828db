"""Helpers that the operators share: Arrow buffers, chunks of texts, folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..tables import HEAVY_KEYS, dropped, few, matched, releasing, shared_dir, written

__all__ = ["HEAVY_KEYS", "dropped", "few", "matched", "releasing", "shared_dir", "written"]

#: Rows of one Arrow batch: bounds what a Python worker holds (texts of some KB each).
ARROW_ROWS = 1000
#: Bytes of text that a worker turns into numpy arrays at a time.
CHUNK_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def extended(df: DataFrame, fields: str) -> StructType:
    """The schema of df with further fields (as DDL)."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])


def fold(doc_id: str | Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array one after the other, and the n + 1 offsets; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES, rows: int = 512) -> Iterator[pa.Array]:
    """Slices of a string array of at most size bytes (or one text) and at most rows rows."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > size or i - start >= rows):
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(texts):
        yield texts.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
