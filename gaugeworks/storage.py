"""Cutting lineage through tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_tables: list[Written] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a temporary one, for local masters only:
    elsewhere each executor would write to a disk of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gaugeworks-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


class Written:
    """A table in the shared folder: written once, read by any executor, deleted by drop(), by scope() or as the program ends."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        _tables.append(self)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if self in _tables:
            _tables.remove(self)
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table written to the shared folder."""
    return Written(df, name).df


@contextmanager
def scope(kept: list[Written] | None = None) -> Iterator[None]:
    """Tables written inside go when it ends, but for those in kept: a job writes its result inside and leaves nothing else behind."""
    before = set(map(id, _tables))
    try:
        yield
    finally:
        stay = before | set(map(id, kept or ()))
        for t in [t for t in _tables if id(t) not in stay]:
            t.drop()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each job inside deletes its shuffle files as it ends; else they stay until the driver collects garbage, which a long job may not see."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


@atexit.register
def _release() -> None:
    for t in list(_tables):
        if t.spark._jsc is not None and t.spark.sparkContext._jsc is not None and not t.spark._jsc.sc().isStopped():
            t.drop()
