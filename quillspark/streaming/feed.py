"""Applying a change feed to a table of key buckets, micro-batch by micro-batch.

The table is a folder: rows of a commit in change-N-.../bucket=B, Parquet, and manifest-N.json, which names the files of each
bucket and the last batch that each feed has applied. A commit reads and rewrites the buckets that it changes and keeps the
files of all others. A manifest's name mustn't be there yet, so of two writers of one version one fails. The files of
older versions than the last few go.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text as T
from ..tables import last_version, new_file, path_of, text_of

#: The column that marks rows with an edit of one's own that isn't sent yet.
DIRTY = "dirty"


def merged(state: DataFrame | None, changes: DataFrame, key: str, clock: str, registers: tuple[str, ...] = ()) -> DataFrame:
    """Of each key the row with the latest clock (a missing one is 0; of equals the greater values), with the largest value of
    each register over all rows. The order of arrival doesn't matter, and equal rows may arrive again."""
    rows = changes if state is None else state.unionByName(changes)
    rest = [c for c in rows.columns if c != key]
    order = F.struct(F.coalesce(clock, F.lit(0)).alias("clock"), T.composite(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest if c != clock)).alias("values"))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"), *(F.max(c).alias(f"_{c}") for c in registers))
    return best.select(key, *((F.col(f"_{c}") if c in registers else F.col("_row")[c]).alias(c) for c in rest))


@dataclass(frozen=True)
class Table:
    """A table kept under folder. keep: versions whose files stay."""

    spark: SparkSession
    folder: str
    key: str
    clock: str
    registers: tuple[str, ...] = ()
    buckets: int = 64
    keep: int = 2

    def manifest(self) -> dict:
        version = last_version(self.spark, self.folder)
        if version is None:
            return {"version": -1, "schema": None, "files": {}, "applied": {}}
        return json.loads(text_of(self.spark, f"{self.folder}/manifest-{version}.json"))

    def _read(self, now: dict, buckets: set[int] | None = None) -> DataFrame | None:
        files = [f"{self.folder}/{at}" for b, at in now["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(now["schema"]).parquet(*files) if files else None

    def read(self) -> DataFrame:
        """The rows of the latest version."""
        now = self.manifest()
        rows = self._read(now)
        if rows is not None:
            return rows
        if now["schema"] is None:
            raise FileNotFoundError(f"no table under {self.folder}")
        return self.spark.createDataFrame([], now["schema"])

    def _of(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _commit(self, now: dict, changed: set[int], rows: DataFrame | None, schema: str, applied: dict) -> None:
        version, files = now["version"] + 1, dict(now["files"])
        if rows is not None:
            at = f"change-{version}-{uuid.uuid4().hex}"
            self._of(rows).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{at}")
            there, path = path_of(self.spark, f"{self.folder}/{at}")
            held = {s.getPath().getName() for s in there.listStatus(path)}
            files = {b: f for b, f in files.items() if int(b) not in changed} | {str(b): f"{at}/bucket={b}" for b in changed if f"bucket={b}" in held}
        new = {"version": version, "schema": schema, "files": files, "applied": now["applied"] | applied}
        new_file(self.spark, f"{self.folder}/manifest-{version}.json", json.dumps(new))
        self._swept(version)

    def _swept(self, version: int) -> None:
        """Delete manifests older than the last few, and files that none of these names."""
        there, top = path_of(self.spark, self.folder)
        names = {s.getPath().getName() for s in there.listStatus(top)}
        kept = [v for v in range(version - self.keep + 1, version + 1) if f"manifest-{v}.json" in names]
        used = {f for v in kept for f in json.loads(text_of(self.spark, f"{self.folder}/manifest-{v}.json"))["files"].values()}
        for v in range(version - self.keep, -1, -1):
            if f"manifest-{v}.json" not in names:
                break
            there.delete(path_of(self.spark, f"{self.folder}/manifest-{v}.json")[1], False)
        for name in names:
            if not name.startswith("change-") or int(name.split("-")[1]) > version:
                continue
            at = path_of(self.spark, f"{self.folder}/{name}")[1]
            parts = {s.getPath().getName() for s in there.listStatus(at) if s.isDirectory()}
            gone = {p for p in parts if f"{name}/{p}" not in used}
            if gone == parts:
                there.delete(at, True)
            else:
                for p in gone:
                    there.delete(path_of(self.spark, f"{self.folder}/{name}/{p}")[1], True)

    def _changed(self, rows: DataFrame) -> set[int]:
        return {r["bucket"] for r in self._of(rows).select("bucket").distinct().collect()}  # at most one row a bucket

    def apply(self, changes: DataFrame, feed: str = "feed", batch: int | None = None) -> None:
        """M3: one commit with the changes of a feed; a batch that is already in changes nothing. Rows that are dirty stay as they are,
        whatever arrives for them: they are still to be sent, and what the server makes of them comes back."""
        now = self.manifest()
        if batch is not None and batch <= now["applied"].get(feed, -1):
            return
        dirty = DIRTY in changes.columns
        changes = changes.persist()  # scanned for its buckets, then merged
        try:
            buckets = self._changed(changes)
            state = self._read(now, buckets)
            new = changes
            if dirty and state is not None:
                new = changes.join(state.filter(DIRTY).select(self.key), self.key, "left_anti")
            rows = merged(state, new.select(changes.columns), self.key, self.clock, self.registers).select(changes.columns) if buckets else None
            schema = now["schema"] or ", ".join(f"`{c}` {t}" for c, t in changes.dtypes)
            self._commit(now, buckets, rows, schema, {feed: batch} if batch is not None else {})
        finally:
            changes.unpersist()

    def edit(self, rows: DataFrame, dirty: bool = True) -> None:
        """One commit with rows in place of those with their keys (each once), marked dirty: edits of one's own; or with dirty=False what the
        server made of them."""
        now = self.manifest()
        rows = rows.withColumn(DIRTY, F.lit(dirty))
        buckets = self._changed(rows)
        state = self._read(now, buckets)
        whole = rows if state is None else state.join(rows.select(self.key), self.key, "left_anti").select(rows.columns).unionByName(rows)
        schema = now["schema"] or ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        self._commit(now, buckets, whole, schema, {})

    def writer(self, feed: DataFrame, name: str = "feed") -> DataStreamWriter:
        """M3: a stream writer that keeps this table. Give it a checkpoint location and a trigger, then start it."""
        return feed.writeStream.foreachBatch(lambda batch, n: self.apply(batch, name, n))
