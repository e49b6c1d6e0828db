"""K1, K4: a full-text index kept under a folder, as a log of segments.

A segment holds the postings of a batch of texts, in runs sorted by term, and their lengths; a file holds all postings of its texts, so
that texts are indexed where they are read. Adding texts writes one segment and marks
the ids that it replaces, if any; removing texts marks ids alone. A posting counts unless its id was marked by a later change, so an
update reads no older postings. merge() rewrites the smaller segments as one, without what no longer counts.

Layout: NAME/postings, NAME/lengths and NAME/marks (ids) of each change, all Parquet and of a name of their own, and manifest-N.json, which
lists what the version N is made of. A manifest is written under a name that must not be there yet, so of two writers of a
version one fails and changes nothing; readers keep the version that they opened.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import last_version, new_file, text_of
from . import search

#: Bytes of a row group of postings: a query reads the groups with its terms only.
ROW_GROUP = 4 << 20


@dataclass(frozen=True)
class Change:
    """The files of the change seq; n and total: the texts that it added and their terms; of marks, n: how many ids they are."""

    seq: int
    name: str
    n: int = 0
    total: int = 0


@dataclass(frozen=True)
class StoredIndex:
    """A version of an index. segments and marks are in the order of the changes."""

    spark: SparkSession = field(repr=False)
    folder: str
    key: str
    fields: tuple[str, ...]
    stems: bool
    version: int
    segments: tuple[Change, ...]
    marks: tuple[Change, ...]
    n: int
    total: int
    id_type: str

    def _read(self, kind: str, change: Change) -> DataFrame:
        schema = {"postings": search.postings_schema(self.id_type), "lengths": f"id {self.id_type}, length long", "marks": f"id {self.id_type}"}
        return self.spark.read.schema(schema[kind]).parquet(self._at(kind, change)).withColumn("_seq", F.lit(change.seq))

    def _at(self, kind: str, change: Change) -> str:
        return f"{self.folder}/{change.name}/{kind}"

    def _next(self) -> Change:
        return Change(self.version + 1, f"change-{self.version + 1}-{uuid.uuid4().hex}")

    def _live(self, kind: str, segments: tuple[Change, ...] | None = None) -> DataFrame:
        """Rows of all segments whose id no later change has marked."""
        segments = self.segments if segments is None else segments
        rows = reduce(DataFrame.unionByName, [self._read(kind, s) for s in segments])
        later = [m for m in self.marks if m.seq > segments[0].seq]
        if later:
            gone = reduce(DataFrame.unionByName, [self._read("marks", m) for m in later]).groupBy("id").agg(F.max("_seq").alias("_gone"))
            gone = F.broadcast(gone) if sum(m.n for m in later) <= search.MARKED else gone
            rows = rows.join(gone.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.col("_seq") < F.col("_gone")), "left_anti")
        return rows

    def index(self) -> search.Index:
        """What search.matching() and search.ranked() take. Their terms are pushed down to the scans of the segments."""
        if not self.segments:
            empty = lambda schema: self.spark.createDataFrame([], schema)
            return search.Index(empty(search.postings_schema(self.id_type)), empty(f"id {self.id_type}, length long"), self.stems, (0, 0))
        return search.Index(self._live("postings").drop("_seq"), self._live("lengths").drop("_seq"), self.stems, (self.n, self.total))

    def _counted(self, ids: DataFrame) -> tuple[int, int]:
        """How many texts with these ids there are, and their terms."""
        if not self.segments:
            return 0, 0
        return tuple(self._live("lengths").join(ids, "id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first())

    def _sized(self, change: Change) -> Change:
        return replace(change, **dict(zip(("n", "total"), self._read("lengths", change).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first(), strict=True)))

    def _committed(self, **changes) -> StoredIndex:
        new = replace(self, version=self.version + 1, **changes)
        state = {f: getattr(new, f) for f in ("key", "fields", "stems", "version", "n", "total", "id_type")} | {f: [asdict(c) for c in getattr(new, f)] for f in ("segments", "marks")}
        new_file(self.spark, f"{self.folder}/manifest-{new.version}.json", json.dumps(state))
        return new

    def add(self, docs: DataFrame) -> StoredIndex:
        """The index with the rows of docs (each id once), in place of earlier ones with these ids."""
        new, docs = self._next(), docs.withColumn(self.key, F.col(self.key).cast(self.id_type))
        docs.select(F.col(self.key).alias("id")).write.parquet(self._at("marks", new))
        postings = search.term_postings(docs, self.key, list(self.fields), self.stems)
        postings.write.option("parquet.block.size", ROW_GROUP).parquet(self._at("postings", new))
        marked = self._read("marks", new).select("id")
        search.text_lengths(marked, "id", self._read("postings", new)).write.parquet(self._at("lengths", new))
        new = self._sized(new)
        gone, lost = self._counted(marked)
        marks = (*self.marks, replace(new, total=0)) if gone else self.marks
        return self._committed(segments=(*self.segments, new), marks=marks, n=self.n + new.n - gone, total=self.total + new.total - lost)

    def remove(self, ids: DataFrame) -> StoredIndex:
        """The index without the texts of ids (id)."""
        new = self._next()
        ids.select(F.col("id").cast(self.id_type).alias("id")).distinct().write.parquet(self._at("marks", new))
        marked = self._read("marks", new).select("id")
        gone, lost = self._counted(marked)
        return self._committed(marks=(*self.marks, replace(new, n=marked.count())), n=self.n - gone, total=self.total - lost)

    def merge(self, ratio: int = 4) -> StoredIndex:
        """The index with its youngest segments as one: those that hold fewer than ratio times the terms of all younger ones together, so that
        there are logarithmically many segments and each posting is rewritten as often. Marks that no older segment needs go."""
        if not self.segments:
            return self
        first, size = len(self.segments) - 1, self.segments[-1].total
        while first and self.segments[first - 1].total < ratio * max(size, 1):
            first -= 1
            size += self.segments[first].total
        young, old = self.segments[first:], self.segments[:first]
        if len(young) == 1 and all(m.seq <= young[0].seq for m in self.marks):
            return self
        new = self._next()
        postings = search.sorted_postings(self._live("postings", young).drop("_seq"))
        postings.write.option("parquet.block.size", ROW_GROUP).parquet(self._at("postings", new))
        self._live("lengths", young).drop("_seq").write.parquet(self._at("lengths", new))
        return self._committed(segments=(*old, self._sized(new)), marks=tuple(m for m in self.marks if old and m.seq > old[0].seq))


def create(spark: SparkSession, folder: str, key: str, fields: list[str], stems: bool = False, id_type: str = "long") -> StoredIndex:
    """An empty index under a folder that all executors share."""
    new = StoredIndex(spark, folder, key, tuple(fields), stems, -1, (), (), 0, 0, id_type)
    return new._committed()


def opened(spark: SparkSession, folder: str, version: int | None = None) -> StoredIndex:
    """The latest version of an index, or the given one."""
    version = last_version(spark, folder) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no index under {folder}")
    state = json.loads(text_of(spark, f"{folder}/manifest-{version}.json"))
    changes = {k: tuple(Change(**c) for c in state.pop(k)) for k in ("segments", "marks")}
    return StoredIndex(spark, folder, fields=tuple(state.pop("fields")), **changes, **state)
