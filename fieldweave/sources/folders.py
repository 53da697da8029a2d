"""Small files in any folder that Spark can reach, by its own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder given by path or URI."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.uri = self._fs.makeQualified(self._root).toString()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def make(self) -> None:
        self._fs.mkdirs(self._root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def files(self, suffix: str) -> list[tuple[str, int]]:
        """Path and size of all files below, whatever their folders are called, sorted by path."""
        found, listing = [], self._fs.listFiles(self._root, True)
        while listing.hasNext():
            f = listing.next()
            if (path := f.getPath().toString()).endswith(suffix):
                found.append((path, f.getLen()))
        return sorted(found)

    def read(self, name: str) -> str:
        return self.read_bytes(name).decode()

    def read_bytes(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a new file and move it over the old one."""
        fresh = self._at(name + ".new")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self._fs.getConf())
        rename = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        rename[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._at(name)), rename)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
