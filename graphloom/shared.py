"""Tables in the folder that the cluster shares: where plans are cut, and what is deleted again once it has been used."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: shuffle files of a finished query go at once, and don't wait for the driver's garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session, as in tests, gets one of its own: on a
    cluster, each executor would write to its own disk, and rows would be lost."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir names no folder, and this is no local session")
    import tempfile

    if spark.sparkContext.applicationId not in OWN:
        OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="graphloom-")
    return OWN[spark.sparkContext.applicationId]


OWN: dict[str, str] = {}


def write(df: DataFrame, folder: str, *by: str) -> DataFrame:
    """df as Parquet in folder, read again; by: columns whose values are folders. What the query has shuffled is deleted with its end."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(*by) if by else out).parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost executor costs nothing upstream. Columns compress
    well in such a table, and later reads take only those that they need."""
    folder = fresh(df.sparkSession, "cut")
    if (made := MADE.get()) is not None:
        made.append(folder)
    out = write(df, folder)
    FOLDERS[out] = folder
    return out


#: The folder of each table that cut() has written.
FOLDERS: WeakKeyDictionary = WeakKeyDictionary()


#: The tables that released() is to delete.
MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def released(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, as a table of its own; all other tables that cut() has written meanwhile are deleted, so that nothing of a lazy
    result stays in the shared folder but itself."""
    token = MADE.set([])
    try:
        out = write(make(), folder := fresh(spark, "cut"))
        FOLDERS[out] = folder
        return out
    finally:
        made = MADE.get()
        MADE.reset(token)
        for f in made:
            delete(spark, f)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() has written, once what is made from them has been written too."""
    for t in tables:
        if folder := FOLDERS.pop(t, None):
            delete(t.sparkSession, folder)


#: Up to so many parts, Spark writes each row of a shuffle straight to its part's file and keeps none in memory.
MOST_PARTS = 200


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to tasks by a hash of columns. A table of one row group is read by one task, however many rows it makes of it: if they hardly
    repeat, what groups them before the shuffle holds all of them there. Dealt first, a task holds its part only."""
    return df.repartition(min(MOST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def once(df: DataFrame) -> DataFrame:
    """df itself if cut() has written it, else cut(df)."""
    return df if df in FOLDERS else cut(df)


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder; nothing, if there is none."""
    path, files = _path(spark, folder)
    return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []


def size(spark: SparkSession, folder: str) -> int:
    path, files = _path(spark, folder)
    return files.getContentSummary(path).getLength() if files.exists(path) else 0


def publish(spark: SparkSession, file: str, text: str) -> None:
    """A small file of its own, as a whole: raises if it is there already, whoever has written it."""
    path, files = _path(spark, file)
    out = files.create(path, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def fresh(spark: SparkSession, name: str) -> str:
    """A folder name of its own in the shared folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
