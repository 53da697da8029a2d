"""Approximate nearest neighbours through learned partitions of a neighbour graph."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import Workspace, bounded, by_cell, lean, mapped
from fieldweave.llm.vectors import as_vectors, lists, matrix, sample_matrix, usable, width_of


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest inner products of each row with other rows, in blocks."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Parts of nearly equal size that cut few edges: median splits first, then moves by gain within the capacity."""
    label = np.zeros(len(x), np.int64)
    groups, rng = [np.arange(len(x))], np.random.default_rng(3)
    while len(groups) < parts:
        split = []
        for g in groups:
            centred = x[g] - x[g].mean(axis=0)
            axis = rng.normal(size=x.shape[1])
            for _ in range(8):  # power iteration towards the widest direction
                axis = centred.T @ (centred @ axis)
                axis /= max(np.linalg.norm(axis), 1e-300)
            by = np.argsort(centred @ axis, kind="stable")
            split += [g[by[: len(g) // 2]], g[by[len(g) // 2 :]]]
        groups = split
    for p, g in enumerate(groups):
        label[g] = p
    most = math.ceil(len(x) / parts * (1 + slack))
    u, v = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        near = np.zeros((len(x), parts))
        np.add.at(near, (u, label[v]), 1)
        np.add.at(near, (v, label[u]), 1)
        want = near.argmax(axis=1)
        gain = near[np.arange(len(x)), want] - near[np.arange(len(x)), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[want[i]] < most and rng.random() < 0.7:  # not all at once, or neighbours swap places for ever
                sizes[label[i]] -= 1
                sizes[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A classifier with one hidden layer: which parts hold a vector's neighbours."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(size=(x.shape[1], hidden)) * math.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.normal(size=(hidden, target.shape[1])) * math.sqrt(1 / hidden), np.zeros(target.shape[1])]
        m, s, step = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                b = order[i : i + 256]
                h = np.maximum(x[b] @ self.w[0] + self.w[1], 0)
                d = (self._softmax(h @ self.w[2] + self.w[3]) - target[b]) / len(b)
                dh = (d @ self.w[2].T) * (h > 0)
                step += 1
                for k, g in enumerate((x[b].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    g = g + 1e-4 * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.w[k] -= 3e-3 * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(z):
        z = np.exp(z - z.max(axis=1)[:, None])
        return z / z.sum(axis=1)[:, None]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]


class LearnedPartitions:
    """Fitted on a bounded sample: the router, and how many parts a query is sent to for the wished recall."""

    def __init__(self, sample: np.ndarray, parts: int, k: int, recall: float, widest: float):
        self.widest = max(widest, 1e-300)
        data, as_query = self.data(sample), self.query(sample)
        train, check = data[: max(1, len(data) * 4 // 5)], as_query[len(data) * 4 // 5 :][:1024]
        self.parts = parts if len(train) > 8 * parts else 1
        self.probes = 1
        if self.parts == 1:
            return
        graph = neighbour_graph(train, min(10, len(train) - 1))
        label = balanced_partition(train, graph, self.parts)
        target = np.zeros((len(train), self.parts))
        np.add.at(target, (np.repeat(np.arange(len(train)), graph.shape[1]), label[graph.ravel()]), 1)
        target[np.arange(len(train)), label] += graph.shape[1] / 2
        self.router = Router(train, target / target.sum(axis=1)[:, None])
        # Recall by the number of parts, on queries that the router hasn't seen.
        own = self.router.scores(data).argmax(axis=1)
        s = check @ data.T
        s[np.arange(len(check)), np.arange(len(data) * 4 // 5, len(data) * 4 // 5 + len(check))] = -np.inf
        best = np.argsort(-s, axis=1)[:, : min(k, len(data) - 1)]
        rank = np.empty((len(check), self.parts), np.int64)
        np.put_along_axis(rank, np.argsort(-self.router.scores(check), axis=1), np.arange(self.parts)[None, :], axis=1)
        hit = np.take_along_axis(rank, own[best], axis=1)
        shares = [(hit < p).mean() for p in range(1, self.parts + 1)]
        self.probes = next((p for p, share in enumerate(shares, 1) if share >= recall), self.parts)
        self.measured = shares[self.probes - 1]

    def data(self, x):
        """Inner product as nearness on a sphere: an added part evens out the lengths."""
        y = x / self.widest
        return np.c_[y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))]

    def query(self, x):
        return np.c_[x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None], np.zeros(len(x))]

    def home(self, x):
        return self.router.scores(self.data(x)).argmax(axis=1) if self.parts > 1 else np.zeros(len(x), np.int64)

    def routes(self, x):
        if self.parts == 1:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-self.router.scores(self.query(x)), axis=1, kind="stable")[:, : self.probes]


def search(vectors: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = 0.96, sample: int = 10_240, block: int = 4096) -> DataFrame:
    """The k rows of largest inner product for each query row, itself left out: query_id, rank, id, score.

    `queries` is a condition on `id_col` that picks the query rows. Parts and router are fitted on at most `sample` vectors chosen by
    hash; the number of parts that a query is sent to is the least that reaches `recall` on held-out queries of the sample. Every row
    is indexed. Parts are searched in blocks of bounded size and hold exact products in double precision; equal vectors are compared
    once, and of their ids only the k + 1 smallest can be in a result. Ties go to the smaller id.

    Vectors that are null, zero, of another width than most, or hold null or non-finite parts, and rows without id, take no part. A query has
    fewer results if there are fewer candidates. Rows with equal ids are one candidate. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "partitions")
    bounded(spark)
    as_given = F.col(f"`{vector_col}`")
    src = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), as_vectors(as_given, vectors.select(as_given).schema[0].dataType).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    kind = src.schema["v"].dataType.simpleString()
    dim = width_of(src, "v")
    good = src.where(usable(F.col("v"), dim) & F.col("id").isNotNull())
    empty = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double").withColumnRenamed("id", id_col)
    classes = work.save(good.groupBy("v").agg(F.min("id").alias("rep"), F.max("asks").alias("asks")), "classes")
    stats = classes.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).alias("widest")).first()
    if not stats["n"]:
        return empty
    parts = 1 << max(0, min(8, round(math.log2(max(1, math.sqrt(stats["n"]) / 14)))))  # grows with the root of the rows
    model = LearnedPartitions(sample_matrix(classes, "v", "rep", dim, sample), parts, k, recall, stats["widest"])

    @lean
    def assign(batches):
        for b in batches:
            x = matrix(b.column(0), dim)
            routes = model.routes(x).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(0), pa.array(model.home(x).astype(np.int32)), lists(routes)], names=["rep", "asks", "v", "home", "routes"])

    placed = work.save(mapped(classes, assign, f"rep bigint, asks boolean, v {kind}, home int, routes array<int>"), "placed")
    m_of = {r["p"]: r["n"] for r in placed.groupBy(F.col("home").alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each part
    q_of = {r["p"]: r["n"] for r in placed.where("asks").select(F.explode("routes").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    shape = spark.createDataFrame([(p, -(-m // block), -(-q_of.get(p, 1) // block)) for p, m in m_of.items()], "part int, mb int, qb int")
    as_member = placed.withColumn("part", F.col("home")).join(F.broadcast(shape), "part").select("part", F.pmod(F.xxhash64("rep"), "mb").cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("other"), F.lit(0).alias("side"), "rep", "v")
    as_query = placed.where("asks").withColumn("part", F.explode("routes")).join(F.broadcast(shape), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("mine"), F.pmod(F.xxhash64("rep"), "qb").cast("int").alias("other"), F.lit(1).alias("side"), "rep", "v")
    cells = as_member.unionByName(as_query).withColumn("cell", F.xxhash64("part", "mine", "other")).repartition("cell").sortWithinPartitions("cell").select("cell", "side", "rep", "v")

    @lean
    def rank(batches):
        for t in by_cell(batches):
            side, rep, x = t.column("side").to_numpy(), t.column("rep").to_numpy(), matrix(t.column("v"), dim)
            m, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(m):
                continue
            for i in range(0, len(q), 512):
                part = q[i : i + 512]
                s = x[part] @ x[m].T
                if len(m) > k + 1:
                    a, b = np.nonzero(s >= np.partition(s, len(m) - k - 1, axis=1)[:, len(m) - k - 1][:, None])
                else:
                    a, b = np.nonzero(np.ones_like(s, bool))
                by = np.lexsort((rep[m[b]], -s[a, b], a))
                a, b = a[by], b[by]
                first = np.searchsorted(a, np.arange(len(part)))
                keep = np.arange(len(a)) - first[a] <= k
                a, b = a[keep], b[keep]
                yield pa.RecordBatch.from_arrays([pa.array(rep[part[a]]), pa.array(rep[m[b]]), pa.array(s[a, b])], names=["ask", "rep", "score"])

    near = cells.mapInArrow(rank, "ask bigint, rep bigint, score double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1).drop("r")
    named = good.join(classes.select("v", "rep"), "v").select("id", "rep", "asks").distinct()
    named = work.save(named, "named")
    ids = named.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("id", "rep")
    top = near.join(ids, "rep").withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    asked = named.where("asks").select(F.col("id").alias("query_id"), F.col("rep").alias("ask"))
    out = asked.join(top.select("ask", "id", "score"), "ask").where("query_id <> id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
