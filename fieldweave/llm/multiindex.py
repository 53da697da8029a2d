"""Embedding near-duplicates through an inverted multi-index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import Workspace, by_cell, lean, mapped, need
from fieldweave.llm.components import connected_components, smallest_reachable
from fieldweave.llm.vectors import as_vectors, distances_to, kmeans, matrix, sample_matrix, units, usable, width_of


def multi_sequence(d1: np.ndarray, d2: np.ndarray, limit: np.ndarray):
    """The cells (i, j) of the product grid that each row visits, in the order of d1[i] + d2[j], nearest first, up to the row's limit.

    Rows are vectors; d1 and d2 hold their distances to the codewords of either half. The front of a traversal has one cell for each first
    codeword: the nearest there that wasn't visited. Its smallest is visited and gives way to its successor. All rows go in step.
    Yields (rows, i, j, sums) step by step, for the rows that go on.
    """
    a, b = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    s1, s2 = np.take_along_axis(d1, a, axis=1), np.take_along_axis(d2, b, axis=1)
    live, at = np.arange(len(d1)), np.zeros(d1.shape, np.int64)
    front = s1 + s2[:, :1]
    while len(live):
        r = front.argmin(axis=1)
        s = front[np.arange(len(live)), r]
        if not (go := s <= limit[live]).all():
            live, front, at, r, s = live[go], front[go], at[go], r[go], s[go]
        own = np.arange(len(live))
        c = at[own, r]
        yield live, a[live, r], b[live, c], s
        at[own, r] = c + 1
        ahead = np.minimum(c + 1, s2.shape[1] - 1)
        front[own, r] = np.where(c + 1 < s2.shape[1], s1[live, r] + s2[live, ahead], np.inf)


class MultiIndex:
    """Two codebooks, one for each half of a unit vector, and how far a vector's visits go.

    A vector visits cells in multi-sequence order until one is farther than its own cell by more than `reach`, which is calibrated on
    vectors turned by exactly the linking angle in random directions, the hardest links there are: the share `recall` of them lies in
    visited cells. A pair counts as found if either end visits the other's cell.
    """

    def __init__(self, sample: np.ndarray, threshold: float, recall: float, size: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.books = [kmeans(part, size, rng) for part in (sample[:, : self.half], sample[:, self.half :])]
        q = sample[:4096]
        turn = rng.normal(size=q.shape)
        turn -= (turn * q).sum(axis=1)[:, None] * q
        turn /= np.maximum(np.linalg.norm(turn, axis=1), 1e-300)[:, None]
        y = threshold * q + math.sqrt(1 - threshold * threshold) * turn
        (d1, d2), (i, j) = self.distances(q), self.cells(*self.distances(y))
        rows = np.arange(len(q))
        self.reach = float(np.quantile(d1[rows, i] + d2[rows, j] - d1.min(axis=1) - d2.min(axis=1), recall)) + 1e-9

    def distances(self, x):
        return distances_to(x[:, : self.half], self.books[0]), distances_to(x[:, self.half :], self.books[1])

    def visits_to(self, x, i, j, limit):
        """Whether vectors visit given cells, one each."""
        return np.square(x[:, : self.half] - self.books[0][i]).sum(axis=1) + np.square(x[:, self.half :] - self.books[1][j]).sum(axis=1) <= limit

    @staticmethod
    def cells(d1, d2):
        return d1.argmin(axis=1), d2.argmin(axis=1)

    def limits(self, d1, d2):
        return d1.min(axis=1) + d2.min(axis=1) + self.reach


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.999, sample: int = 16_384, per_cell: int = 64, members: int = 2048, queries: int = 8192) -> DataFrame:
    """One row for each row of `vectors`: id, n_links, component_id, kept.

    Links are pairs with cosine >= `threshold` in double precision. Codebooks are fitted on at most `sample` vectors; every vector
    is indexed. Equal vectors are one class with a weight; they link with each other and share their links, so copies are never
    compared in pairs. A vector is sent once to each row of the grid that it visits, with the cells that it visits there, and meets that
    row's members in blocks of bounded size. Tasks return link counts and spanning edges, not pairs.

    Vectors that are null, zero, of another width than most, or hold null or non-finite parts link with nothing and are kept; so do
    rows without id, which have no component. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "multiindex")
    src = need(vectors, id_col, vector_col).toDF("id", "v")
    src = src.select(F.col("id").cast("bigint").alias("id"), as_vectors(F.col("v"), src.schema["v"].dataType).alias("v"))
    kind = src.schema["v"].dataType.simpleString()
    dim = width_of(src, "v")
    good = src.where(usable(F.col("v"), dim) & F.col("id").isNotNull())
    classes = work.save(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("w")), "classes")
    n = classes.count()
    out_rows = src.select("id")
    if not n:
        return out_rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    fit = sample_matrix(classes, "v", "rep", dim, sample)
    fit = units(fit)
    size = max(2, min(512, len(fit) // 8 or 1, round(math.sqrt(n / per_cell))))
    index = MultiIndex(fit, threshold, recall, size)

    @lean
    def assign(batches):
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            x = units(matrix(b.column(0), dim))
            d1, d2 = index.distances(x)
            i, j = index.cells(d1, d2)
            limit = index.limits(d1, d2)
            who, row, col, _ = (np.concatenate(c) for c in zip(*multi_sequence(d1, d2, limit), strict=True))
            by = np.lexsort((col, row, who))
            who, row, col = who[by], row[by], col[by]
            new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (row[1:] != row[:-1])])
            cells = pa.ListArray.from_arrays(pa.array(np.r_[new, len(who)].astype(np.int32)), pa.array(col.astype(np.int32)))
            rows = pa.StructArray.from_arrays([pa.array(row[new].astype(np.int32)), cells], names=["row", "cells"])
            off = np.searchsorted(who[new], np.arange(len(x) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(0), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(limit), pa.ListArray.from_arrays(pa.array(off), rows)], names=["rep", "w", "v", "i", "j", "reach", "visits"])

    placed = work.save(mapped(classes, assign, f"rep bigint, w bigint, v {kind}, i int, j int, reach double, visits array<struct<row:int,cells:array<int>>>"), "placed")
    m_of = {r["i"]: r["n"] for r in placed.groupBy("i").agg(F.count("*").alias("n")).collect()}  # one row for each codeword
    q_of = {r["i"]: r["n"] for r in placed.select(F.explode("visits.row").alias("i")).groupBy("i").agg(F.count("*").alias("n")).collect()}
    shape = spark.createDataFrame([(i, -(-m // members), -(-q_of.get(i, 1) // queries)) for i, m in m_of.items()], "row int, mb int, qb int")
    both = ("rep", "w", "v", "i", "j", "reach")
    as_member = placed.withColumn("row", F.col("i")).join(F.broadcast(shape), "row").select("row", F.pmod(F.xxhash64("rep"), "mb").cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("other"), F.lit(0).alias("side"), *both, F.lit(None).cast("array<int>").alias("cells"))
    as_query = placed.withColumn("visit", F.explode("visits")).withColumn("row", F.col("visit.row")).join(F.broadcast(shape), "row").select("row", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("mine"), F.pmod(F.xxhash64("rep"), "qb").cast("int").alias("other"), F.lit(1).alias("side"), *both, "visit.cells")
    cells = as_member.unionByName(as_query).withColumn("cell", F.xxhash64("row", "mine", "other"))
    cells = cells.repartition("cell").sortWithinPartitions("cell").select("cell", "row", "side", *both, "cells")

    @lean
    def compare(batches):
        for t in by_cell(batches):
            side, rep, w, i, j, reach = (t.column(k).to_numpy() for k in ("side", "rep", "w", "i", "j", "reach"))
            m, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(m) or not len(q):
                continue
            x, visited = units(matrix(t.column("v"), dim)), t.column("cells").combine_chunks()
            visited = visited.chunk(0) if isinstance(visited, pa.ChunkedArray) else visited
            many = np.diff(visited.offsets.to_numpy())  # members have none
            col, who = visited.values.to_numpy()[visited.offsets[0].as_py() :], np.repeat(np.arange(len(x)), many)
            by = np.argsort(col[: len(who)], kind="stable")
            col, who, left, right = col[by], who[by], [], []
            for c in np.unique(j[m]):  # the grid's cells in this row
                own, visitors = m[j[m] == c], who[np.searchsorted(col, c) : np.searchsorted(col, c, side="right")]
                a, b = np.nonzero(x[visitors] @ x[own].T >= threshold)
                keep = rep[visitors[a]] != rep[own[b]]
                left.append(visitors[a][keep])
                right.append(own[b][keep])
            u, v = np.concatenate(left), np.concatenate(right)
            if not len(u):
                continue
            count = np.zeros(len(x), np.int64)
            np.add.at(count, u, w[v])
            alone = ~index.visits_to(x[v], i[u], j[u], reach[v])  # the member doesn't visit the query's cell, so the pair is seen only here
            np.add.at(count, v[alone], w[u[alone]])
            label = smallest_reachable(u, v, len(x))
            counted, joined = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(x)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[rep[counted], rep[joined]]), pa.array(np.r_[count[counted], np.zeros(len(joined), np.int64)]), pa.array(np.r_[rep[counted], rep[label[joined]]])], names=["rep", "n", "to"]
            )

    found = work.save(mapped(cells, compare, "rep bigint, n bigint, `to` bigint"), "found")
    comp = work.save(connected_components(found.where("rep <> `to`").select("rep", "to"), work), "components")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    per_class = classes.join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # Null as the key keeps vectors that take no part out of the join's hot spots.
    keyed = src.withColumn("v", F.when(usable(F.col("v"), dim) & F.col("id").isNotNull(), F.col("v")))
    out = keyed.where("v is not null").join(per_class, "v").select("id", "n_links", "component_id")
    rest = keyed.where("v is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
