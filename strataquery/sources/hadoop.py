"""Small files and folders on any file system that Spark reaches."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """Operations below one root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def changed(self, name: str) -> int:
        """When the file or folder was last written, in milliseconds."""
        return self._fs.getFileStatus(self._path(name)).getModificationTime()

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)

    def read_json(self, name: str):
        """The document, or None if there is none."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def create_json(self, name: str, value) -> bool:
        """Write a new document; false if there is one already. Of several callers only one gets true."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
            stream.hsync()
        finally:
            stream.close()
        return True

    def rename(self, name: str, to: str) -> bool:
        """False if there is nothing to rename."""
        try:
            return self._fs.rename(self._path(name), self._path(to))
        except Py4JJavaError:
            if not self.exists(name):
                return False
            raise

    def write_json(self, name: str, value) -> None:
        """Replace the document at once: readers see the old or the new one."""
        part = f"{name}.part"
        stream = self._fs.create(self._path(part), True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
            stream.hsync()
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        rename = self.spark.sparkContext._gateway.new_array(options, 1)
        rename[0] = options.OVERWRITE
        where = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        where.rename(self._path(part), self._path(name), rename)
