"""Stored tables: versioned folders, and the folder for tables that live as long as a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def session_dir(spark: SparkSession) -> str:
    """A new folder that all executors share and that goes when the session's JVM ends.

    It lies in spark.checkpoint.dir; without that, in the warehouse, or in a temporary folder of a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = "file://" + tempfile.mkdtemp(prefix="skeinwork-") if local else spark.conf.get("spark.sql.warehouse.dir")
    where = f"{base.rstrip('/')}/skeinwork-{uuid.uuid4().hex}"
    path, fs = _path(spark, where)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return where


class Versions:
    """Tables of one path in versions. A reader sees the version named by the file CURRENT, which is written last."""

    def __init__(self, spark: SparkSession, path: str, version: str | None = None):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version

    def begin(self) -> Versions:
        return Versions(self.spark, self.path, f"version-{uuid.uuid4().hex}")

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{self.version}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that the build alone needed."""
        path, fs = _path(self.spark, f"{self.path}/{self.version}/{name}")
        fs.delete(path, True)

    def commit(self) -> None:
        """Make this version the current one and drop the one before."""
        before = self._named()
        path, fs = _path(self.spark, f"{self.path}/CURRENT")
        out = fs.create(path, True)
        out.write(bytearray(self.version.encode()))
        out.close()
        if before and before != self.version:
            fs.delete(_path(self.spark, f"{self.path}/{before}")[0], True)

    def current(self) -> Versions:
        if (name := self._named()) is None:
            raise FileNotFoundError(f"no finished version at {self.path}")
        return Versions(self.spark, self.path, name)

    def _named(self) -> str | None:
        path, fs = _path(self.spark, f"{self.path}/CURRENT")
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0] if fs.exists(path) else None
