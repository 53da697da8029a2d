"""Scan of interface-definition files as a Spark data source.

The driver lists, sorted by path, so that empty files and hidden folders count, which Spark's own file sources skip. Executors read:
one row for each file, with the text or, for a file that can't be read or isn't UTF-8, the reason in `error`.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldweave.errors import DataAccessError, NotFoundError
from fieldweave.schemas import PROTO_FILE
from fieldweave.sources.folders import Folder


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.per_task = options["path"], int(options.get("filespertask", "64"))

    def partitions(self):
        root = Path(self.root)
        found = sorted(root.rglob("*.proto")) if root.is_dir() else [root]
        listed = [(i, str(p)) for i, p in enumerate(found)]
        return [_Files(listed[i : i + self.per_task]) for i in range(0, len(listed), self.per_task)] or [_Files([])]

    def read(self, partition):
        for order, path in partition.files:
            try:
                yield order, path, Path(path).read_bytes().decode("utf-8"), None
            except (OSError, UnicodeDecodeError) as e:
                yield order, path, None, f"{type(e).__name__}: {e}"


class ProtoFileSource(DataSource):
    """spark.read.format("protofiles").load(path), of one file or a folder and all below it."""

    @classmethod
    def name(cls):
        return "protofiles"

    def schema(self):
        return PROTO_FILE

    def reader(self, schema):
        return _Reader(self.options)


def scan_folder(spark: SparkSession, path: str | Path) -> DataFrame:
    """All definition files below a folder; files that can't be read keep a row with `error`.

    A folder given as URI is listed and read through Spark's file systems, empty files and hidden folders too.
    """
    if "://" in str(path):
        return _scan_remote(spark, str(path))
    if not Path(path).exists():
        raise NotFoundError("DIR_NOT_FOUND", f"no such folder: {path}", {"path": str(path)})
    spark.dataSource.register(ProtoFileSource)
    return spark.read.format("protofiles").load(str(path))


def _scan_remote(spark: SparkSession, uri: str) -> DataFrame:
    folder = Folder(spark, uri)
    listed = folder.files(".proto")  # the driver lists, as it does for local folders
    below = len(folder.uri.rstrip("/")) + 1
    reader = spark.read.format("binaryFile")
    found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.proto").load(uri).select("path", "content")
    # What Spark's file source passes over: files in hidden folders are named to it, those with hidden names of their own, which
    # are few, are read by the driver, and empty files have nothing to read.
    hidden = [p[below:].split("/") for p, size in listed if size and any(part[0] in "._" for part in p[below:].split("/") if part)]
    if named := ["/".join([folder.uri.rstrip("/"), *parts]) for parts in hidden if parts[-1][0] not in "._"]:
        found = found.union(reader.load(named).select("path", "content")).dropDuplicates(["path"])
    if own := ["/".join(parts) for parts in hidden if parts[-1][0] in "._"]:
        found = found.union(spark.createDataFrame([(f"{folder.uri.rstrip('/')}/{name}", bytearray(folder.read_bytes(name))) for name in own], "path string, content binary"))
    order = spark.createDataFrame([(i, p, size) for i, (p, size) in enumerate(listed)], "file_ord bigint, path string, size bigint")
    text = F.try_validate_utf8(F.when(F.col("size") == 0, F.lit("")).otherwise(F.col("content").cast("string")))
    error = F.when(text.isNull(), F.lit("UnicodeDecodeError: not UTF-8"))
    return order.join(found, "path", "left").select("file_ord", F.col("path").alias("file_path"), text.alias("content"), error.alias("error"))


def scan_file(spark: SparkSession, path: str | Path) -> DataFrame:
    """One definition file; here one that can't be read is an error."""
    path = Path(path)
    if not path.exists():
        raise NotFoundError("PROTO_NOT_FOUND", f"no such file: {path}", {"path": str(path)})
    try:
        with path.open("rb"):
            pass
    except OSError as e:
        raise DataAccessError("PROTO_READ_ERROR", f"can't read {path}", {"path": str(path)}, e) from e
    spark.dataSource.register(ProtoFileSource)
    return spark.read.format("protofiles").load(str(path))


def split_errors(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be used, and the others as a dead-letter table (file_path, error)."""
    return files.where("error is null"), files.where("error is not null").select("file_path", "error")
