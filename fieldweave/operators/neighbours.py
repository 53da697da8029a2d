"""Nearest neighbours of a few queries in a catalog of vectors, and filters over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Queries that are sent to all tasks at once; more meet the catalog in cells of so many queries and MEMBERS catalog rows.
BLOCK = 2_000
MEMBERS = 20_000


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def top_k(queries: DataFrame, catalog: DataFrame, k: int = 10, query_key: str = "query_key", id_col: str = "id", vector: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """The k catalog rows nearest to each query: query_key, rank (from 1), id, distance and the columns in `carry`; ties by id.

    A query set against all rows. Up to BLOCK queries reach the tasks whole, and the catalog stays where it is. More are dealt with the
    catalog into cells of bounded size, so that neither side passes through the driver. Either way a task compares by matrix product
    and gives each query's k best of its batch, with distances computed anew from the parts; no other pair leaves it. Rows without a
    vector take no part; vectors of different widths aren't compared.
    """
    q = queries.select(F.col(query_key).alias("query_key"), F.col(vector).alias("_v")).where("_v is not null")
    rows = catalog.select(id_col, *carry, F.col(vector).alias("_v")).where("_v is not null")
    asked = q.count()
    schema = T.StructType([T.StructField("query_key", q.schema["query_key"].dataType), T.StructField("distance", T.DoubleType()), *[f for f in rows.schema.fields if f.name != "_v"]])
    found = _in_batches(q, rows, k, schema) if asked <= BLOCK else _in_cells(q, rows, k, schema, id_col, -(-asked // BLOCK))
    order = Window.partitionBy("query_key").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_key", "rank", id_col, "distance", *carry)


def _by_width(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Width -> (places, matrix) of a column of lists."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    widths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    found = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths) if w > 0}
    return {w: (at, np.array(vectors.take(pa.array(at)).flatten(), np.float64).reshape(-1, w)) for w, at in found.items()}


def _best(asked: dict, keys: pa.Array, batch: pa.RecordBatch, k: int, schema: T.StructType):
    """Each query's k nearest of a batch whose last column holds the vectors; all that are as near as the k-th."""
    for w, (places, x) in _by_width(batch.column(batch.num_columns - 1)).items():
        if w not in asked:
            continue
        who, q = asked[w]
        rough = (x * x).sum(axis=1)[None, :] + (q * q).sum(axis=1)[:, None] - 2 * q @ x.T
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(x) > k else rough.max(axis=1)
        i, j = np.nonzero(rough <= edge[:, None] + 1e-9 * (1 + np.abs(edge))[:, None])
        d = ((x[j] - q[i]) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(who[i])), pa.array(d), *[c.take(pa.array(places[j])) for c in batch.columns[:-1]]], names=schema.names)


def _in_batches(q: DataFrame, rows: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    table = q.toArrow().combine_chunks()  # BLOCK rows at most
    keys, asked = pa.concat_arrays(table.column(0).chunks) if table.num_rows else pa.array([]), _by_width(table.column(1)) if table.num_rows else {}

    def run(batches):
        for b in (whole.slice(i, 4096) for whole in batches for i in range(0, whole.num_rows, 4096)):
            yield from _best(asked, keys, b, k, schema)

    return rows.mapInArrow(run, schema)


def _in_cells(q: DataFrame, rows: DataFrame, k: int, schema: T.StructType, id_col: str, blocks: int) -> DataFrame:
    parts = max(1, -(-rows.count() // MEMBERS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rest = [f for f in rows.schema.fields if f.name != "_v"]
    asking = q.select(F.pmod(F.xxhash64("query_key"), F.lit(blocks)).cast("int").alias("_q"), spread(parts).alias("_m"), "query_key", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest], "_v")
    members = rows.select(spread(blocks).alias("_q"), F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("_m"), F.lit(None).cast(schema["query_key"].dataType).alias("query_key"), *[f.name for f in rest], "_v", F.lit(1).alias("_side"))
    both = asking.withColumn("_side", F.lit(0)).union(members)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("_side").to_numpy()
        asks, given = (table.take(pa.array(np.flatnonzero(side == n))).combine_chunks() for n in (0, 1))
        out = []
        if asks.num_rows and given.num_rows:
            keys = pa.concat_arrays(asks.column("query_key").chunks)
            wanted = given.select([*(f.name for f in rest), "_v"])
            for b in wanted.to_batches(max_chunksize=4096):
                out += _best(_by_width(asks.column("_v")), keys, b, k, schema)
        return pa.Table.from_batches(out) if out else to_arrow_schema(schema).empty_table()

    return both.groupBy("_q", "_m").applyInArrow(run, schema)


def drop_own_file(hits: DataFrame, path: str, column: str = "metadata.file_path") -> DataFrame:
    """Hits from other files. After the ranking, so that fewer than k may be left."""
    return hits.where(F.col(column) != path)


def close(hits: DataFrame, cut: float = 0.5) -> DataFrame:
    """Queries' first hits nearer than the cut."""
    first = hits.withColumn("_first", F.row_number().over(Window.partitionBy("query_key").orderBy("rank"))).where("_first = 1")
    return first.where(F.coalesce("distance", F.lit(1.0)) < cut).drop("_first")
