"""Vector intake shared by the vector operators: which vectors take part, and one row for each distinct vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def usable(v: Column, dim: int) -> Column:
    """Not null, of the given width, all parts finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def width_of(vectors: DataFrame, column: str) -> int:
    """The width that most vectors have; ties go to the smaller."""
    row = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def as_vectors(v: Column, kind: DataType) -> Column:
    """A list column as an array of floats, if it is one, or else of doubles: what is sent around is no wider than what was given."""
    return v.cast(kind if kind.simpleString() == "array<float>" else "array<double>")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists, all of one width, as a double-precision matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled first so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.sqrt(np.square(x).sum(axis=1))[:, None]


def lists(m: np.ndarray) -> pa.ListArray:
    off = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(m).ravel()))


def sample_matrix(vectors: DataFrame, column: str, id_col: str, dim: int, most: int) -> np.ndarray:
    """At most `most` vectors, chosen by a hash of the id, so that the choice doesn't depend on the layout."""
    rows = vectors.select(column).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(most).toArrow()
    return matrix(rows.column(0), dim) if rows.num_rows else np.zeros((0, max(dim, 1)))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from random rows; an empty cluster restarts at the row farthest from its centre."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = squares(x, centres)
        near = d.argmin(axis=1)
        for j in range(len(centres)):
            own = x[near == j]
            centres[j] = own.mean(axis=0) if len(own) else x[d.min(axis=1).argmax()]
    return centres


def distances_to(x: np.ndarray, c: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Squared distances of rows of x to rows of c, each the same number whatever other rows are there, unlike a matrix product's."""
    rows = max(1, step // max(1, c.size))
    return np.concatenate([np.square(x[i : i + rows, None] - c[None]).sum(axis=2) for i in range(0, len(x), rows)] or [np.zeros((0, len(c)))])


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0)
