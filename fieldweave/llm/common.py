"""What the operators of this subpackage share: scratch tables, Arrow text views and 64-bit hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import hashlib
import os
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

U64 = np.uint64


class Workspace:
    """Intermediate tables in the folder that `spark.checkpoint.dir` names.

    Where that setting is absent (tests, a laptop), a temporary folder is taken, which is only right in local mode.
    Tables cut the lineage, so a lost executor costs at most the stage that was running.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded(spark)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = _local_base()
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str, thin: bool = False) -> DataFrame:
        """Write `df` once and go on from the written table.

        `thin` is for rows of a few numbers that come from a shuffle: eight of its partitions go to a file, so that files don't get tiny.
        """
        if thin:
            df = df.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        full = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
        local = re.fullmatch(r"file:(?://)?(/(?!/).*)", full)
        if local and df.columns and all(_plain(f.dataType) for f in df.schema.fields):
            out = self._save_local(df, path, local[1])
        else:
            df.write.parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        out._fieldweave_path = path
        return out

    def _save_local(self, df: DataFrame, path: str, folder: str) -> DataFrame:
        """Write by Python workers.

        For every folder and file in a local path Spark's writer has the JVM start `chmod`, six times a task, and until that process
        has its own program it counts with all memory of the JVM. This way none starts. Columns are named by their place. Rows that
        mapped() makes are written by the workers that make them, so that no task needs one worker more.
        """
        inner = StructType([StructField(f"_{i}", f.dataType) for i, f in enumerate(df.schema.fields)])
        os.makedirs(folder)
        src, run = getattr(df, "_fieldweave_run", None) or (df.toDF(*inner.names), iter)
        src.mapInArrow(_written(run, folder, to_arrow_schema(inner)), "n bigint").collect()
        return self.spark.read.schema(inner).parquet(path).toDF(*df.columns)

    def drop(self, df: DataFrame | None) -> None:
        """Delete the files of a table that save() returned and nothing reads any more."""
        if df is not None and getattr(df, "_fieldweave_path", None):
            self._delete(df._fieldweave_path)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended; the folder is scratch space
            pass


GROUP = 8 << 20  # bytes in memory of a row group


def _plain(kind: DataType) -> bool:
    """Whether Arrow writes a column of this type as Spark does."""
    if isinstance(kind, ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, StructType):
        return len(kind.fields) > 0 and all(_plain(f.dataType) for f in kind.fields)
    return kind == StringType() or isinstance(kind, (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, BinaryType))


def _written(run, folder: str, schema: pa.Schema):
    """A function that writes what `run` makes of a partition's batches to one file in `folder` and returns no rows.

    The file gets its name when it is whole, so what a failed attempt leaves is never read, and a repeated one replaces it. A partition
    without rows has no file.
    """

    @lean
    def write(batches):
        import pyarrow.parquet as pq

        name = f"part-{TaskContext.get().partitionId():05d}.parquet"
        scratch = f"{folder}/.{name}-{uuid.uuid4().hex}"
        held, size, out = [], 0, None
        try:
            for b in run(batches):
                if b.num_rows:
                    held.append(b)
                    size += b.nbytes
                if size >= GROUP:
                    out = out or pq.ParquetWriter(scratch, schema)
                    out.write_table(pa.Table.from_batches(held).rename_columns(schema.names).cast(schema))
                    held, size = [], 0
            if held:
                out = out or pq.ParquetWriter(scratch, schema)
                out.write_table(pa.Table.from_batches(held).rename_columns(schema.names).cast(schema))
            if out:
                out.close()
                os.replace(scratch, f"{folder}/{name}")
        finally:
            if out:
                out.close()
            with contextlib.suppress(FileNotFoundError):
                os.remove(scratch)
        yield from ()

    return write


@lru_cache(maxsize=1)
def _local_base() -> str:
    folder = tempfile.mkdtemp(prefix="fieldweave-")
    atexit.register(shutil.rmtree, folder, True)
    return "file://" + folder


def utf8_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    dtype = np.int64 if wide else np.int32
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, dtype, count=len(arr) + 1, offset=arr.offset * dtype().itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def runs_of(off: np.ndarray, most: int):
    """Row ranges [i, j) of about `most` bytes each; a longer row stands alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values evenly."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
LONG = 1024  # bytes from which a span's hash is a digest, so that one huge span doesn't take a step for each of its words


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time: each step mixes the next bytes into what the ones before gave.

    No step is linear, so texts with a structure (repetitive ones above all) collide no more often than others. Equal bytes give equal
    values wherever they stand. The steps of all spans run side by side; spans of LONG bytes and more take a BLAKE2 digest.
    """
    eight = eights(data)
    out = mix64(size.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 % 2**64))
    live = np.flatnonzero((size > 0) & (size < LONG))
    at, left, h = start[live], size[live], out[live]
    while len(live):
        h = mix64((h ^ (eight[at] & MASK[np.minimum(left, 8)])) * U64(0xD6E8FEB86659FD93))
        out[live] = h
        more = np.flatnonzero(left > 8)
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of spans, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def same_spans(data: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] equals other[b : b + size], elementwise, on the bytes, eight at a time."""
    one, two, out = eights(data), eights(other), np.ones(len(size), bool)
    live = np.flatnonzero((size > 0) & (size < LONG))
    x, y, left = a[live], b[live], size[live]
    while len(live):
        same = ((one[x] ^ two[y]) & MASK[np.minimum(left, 8)]) == 0
        out[live[~same]] = False
        more = np.flatnonzero(same & (left > 8))
        live, x, y, left = live[more], x[more] + 8, y[more] + 8, left[more] - 8
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = np.array_equal(data[a[i] : a[i] + size[i]], other[b[i] : b[i] + size[i]])
    return out


class PrefixHash:
    """Polynomial hashes modulo 2**64 over bytes: any substring's hash from two prefix values.

    Long texts with a structure can collide (Thue-Morse words of some hundred bytes do), so what rests on equal values must be verified.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=U64)
        self.base = int(rng.integers(0, 2**63, dtype=U64)) * 2 + 1
        self.powers = self.inverse = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = n + n // 4 + 1024
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 2**64))):
                a = np.full(size, base % 2**64, U64)
                a[0] = 1
                np.multiply.accumulate(a, out=a)
                setattr(self, name, a)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], elementwise; equal bytes give equal values wherever they stand."""
        return (prefix[end] - prefix[start]) * self.inverse[start]


def crc32_of(column: str):
    """crc32 of a number written as text."""
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary"))


def quoted(names) -> list:
    """Columns by their names, whatever these hold."""
    return [F.col(f"`{c}`") for c in names]


def map_rows(df: DataFrame, run, schema: StructType | None = None) -> DataFrame:
    """mapInArrow over rows of any column names: inside, columns are named by their place. `schema` is the result's, by default that of `df`."""
    schema = schema or df.schema
    inner = StructType([StructField(f"_{i}", f.dataType) for i, f in enumerate(schema.fields)])
    src = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    out = src.mapInArrow(run, inner).toDF(*schema.names)
    out._fieldweave_run = src, run
    return out


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow, for rows that Workspace.save() may write where they are made."""
    out = df.mapInArrow(run, schema)
    out._fieldweave_run = df, run
    return out


def bounded(spark: SparkSession, rows: int = 2000) -> None:
    """Lower the session's Arrow batches to `rows` rows and 8 MB, so that a worker holds a few megabytes of texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that an operator reads, so that others, whatever their names, can't clash."""
    bounded(df.sparkSession)
    return df.select(*quoted(columns))


def lean(run):
    """A function over batches that gives back the memory it no longer needs when its partition ends; workers live on."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return wrapped


def by_cell(batches, column: str = "cell"):
    """Tables of all rows with one value of `column`, from batches sorted by it; what is held is one cell and one batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column(b.schema.get_field_index(column)).to_numpy()
        at = 0
        for cut in [*np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]:
            if held and key[at] != held[0].column(held[0].schema.get_field_index(column))[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            if cut > at:
                held.append(b.slice(at, cut - at))
            at = cut
    if held:
        yield pa.Table.from_batches(held)
