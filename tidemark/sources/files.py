"""Files of a store on any file system that Spark can reach.

With a Spark session all goes through its Hadoop file systems, so a root may
be ``hdfs://``, ``s3a://`` or a mounted folder; without one, only folders of
this machine can be looked at.
"""

from __future__ import annotations

import glob
import os
from pathlib import Path
from typing import Protocol

from pyspark.sql import SparkSession


class Files(Protocol):
    def mkdirs(self, path: str) -> None: ...
    def is_dir(self, path: str) -> bool: ...
    def exists(self, path: str) -> bool: ...
    def read_text(self, path: str) -> str: ...
    def write_text(self, path: str, text: str) -> None: ...
    def rename(self, old: str, new: str) -> bool: ...
    def delete(self, path: str) -> None: ...
    def matching(self, pattern: str) -> list[str]: ...


class LocalFiles:
    """Folders of this machine, without Spark."""

    def mkdirs(self, path: str) -> None:
        Path(path).mkdir(parents=True, exist_ok=True)

    def is_dir(self, path: str) -> bool:
        return Path(path).is_dir()

    def exists(self, path: str) -> bool:
        return Path(path).exists()

    def read_text(self, path: str) -> str:
        return Path(path).read_text()

    def write_text(self, path: str, text: str) -> None:
        Path(path).write_text(text)

    def rename(self, old: str, new: str) -> bool:
        if os.path.exists(new):
            return False
        os.rename(old, new)
        return True

    def delete(self, path: str) -> None:
        import shutil

        shutil.rmtree(path) if os.path.isdir(path) else os.path.exists(path) and os.remove(path)

    def matching(self, pattern: str) -> list[str]:
        return sorted(glob.glob(pattern))


class HadoopFiles:
    """Whatever the session's Hadoop configuration knows."""

    def __init__(self, spark: SparkSession) -> None:
        self._sc = spark.sparkContext

    def _at(self, path: str):
        where = self._sc._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._sc._jsc.hadoopConfiguration())

    def mkdirs(self, path: str) -> None:
        where, fs = self._at(path)
        fs.mkdirs(where)

    def is_dir(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where) and fs.getFileStatus(where).isDirectory()

    def exists(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where)

    def read_text(self, path: str) -> str:
        where, fs = self._at(path)
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        where, fs = self._at(path)
        stream = fs.create(where, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        # Hadoop moves into a folder that is there; a store never wants that.
        if self.exists(new):
            return False
        source, fs = self._at(old)
        return fs.rename(source, self._at(new)[0])

    def delete(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)

    def matching(self, pattern: str) -> list[str]:
        where, fs = self._at(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(where) or [])


def files(spark: SparkSession | None = None) -> Files:
    """Those of the given or the active session, else of this machine."""
    spark = spark or SparkSession.getActiveSession()
    return HadoopFiles(spark) if spark is not None else LocalFiles()
