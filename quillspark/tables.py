"""Tables in the shared folder, and joins that take heavy keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). In local mode a temporary one where that is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


@contextlib.contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of each query go when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def path_of(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage. The table goes when the driver ends, or by dropped()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with releasing(spark):
        df.write.parquet(path)
    files, at = path_of(spark, path)
    files.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for table in tables:
        files, at = path_of(table.sparkSession, table._written_at)
        files.delete(at, True)


def new_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file that mustn't be there yet."""
    files, at = path_of(spark, path)
    out = files.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def text_of(spark: SparkSession, path: str) -> str:
    """A small text file."""
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def last_version(spark: SparkSession, folder: str) -> int | None:
    """The highest N of the files manifest-N.json of a folder; None without any."""
    files, at = path_of(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return max((int(n[len("manifest-") : -len(".json")]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=None)


#: Keys that matched() broadcasts, at most.
HEAVY_KEYS = 4096


def matched(rows: DataFrame, one: DataFrame, keys: list[str], met: str = "met", how: str = "inner") -> DataFrame:
    """rows with the columns of one (a table), which has a row for each of their keys and how many rows have it (met).

    Keys with a HEAVY_KEYS-th of all rows or more, so HEAVY_KEYS at most, are broadcast; a task of the sorted rest gets no heavy key.
    how: left keeps rows without a match as well.
    """
    total = one.agg(F.sum(met)).first()[0] or 0
    heavy = F.col(met) * HEAVY_KEYS >= total
    few, rest = one.filter(heavy).drop(met), one.filter(~heavy).drop(met)
    out = rows.join(F.broadcast(few), keys)
    return out if how == "inner" and rest.isEmpty() else out.unionByName(rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest, keys, how))


#: Numbers that few() broadcasts, at most.
FEW = 1 << 20


def few(ids: DataFrame, most: int = FEW) -> DataFrame:
    """ids (a table of one column of longs), to be broadcast if they are that few; beyond that, as Spark joins."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids
