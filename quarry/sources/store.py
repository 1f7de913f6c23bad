"""Files through Hadoop's file systems, so tables can lie wherever Spark can write."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Temporary folders of local sessions without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, in that of spark.checkpoint.dir; a local one only for local sessions where that is unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Conflict(RuntimeError):
    """Another writer made the file first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none if it does not exist."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)

    def create(self, name: str, value) -> None:
        """Writes JSON to a file that must not exist. The file is written aside and then named, so no reader meets a part of
        it, and of several writers one succeeds: by a hard link on a local disk, by a rename that does not replace elsewhere
        (which object stores must offer themselves)."""
        folder, _, base = name.rpartition("/")
        aside = self._path(f"{folder}/.{base}.{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        try:
            self._name(aside, self._path(name))
        except Exception as e:
            if self.exists(name):
                raise Conflict(name) from e
            raise
        finally:
            self.fs.delete(aside, False)

    def _name(self, aside, target) -> None:
        if self.fs.getScheme() == "file":
            os.link(aside.toUri().getPath(), target.toUri().getPath())
        else:
            self._rename(aside, target)

    def _rename(self, aside, target) -> None:
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(aside), context.makeQualified(target), no_options)

    def read(self, name: str):
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
