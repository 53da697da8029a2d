"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import Workspace, lean, mapped

BATCH = 400_000  # edges that a task joins at once


def smallest_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest reachable node for each of n nodes; u, v are edge ends. Labels hook onto smaller ones and jump to their label's."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v):
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _local_forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges replaced by stars around the smallest node of each of its own components, BATCH edges at a time."""

    @lean
    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            size += b.num_rows
            if size > BATCH:
                held = [forest(held)]
                size = held[0].shape[1]
                if size > BATCH // 2:
                    yield batch(held[0])
                    held, size = [], 0
        if size:
            yield batch(forest(held))

    def forest(held):
        ends = np.concatenate(held, axis=1)
        nodes, at = np.unique(ends, return_inverse=True)
        u, v = at.reshape(2, -1)
        root = smallest_reachable(u, v, len(nodes))
        far = np.flatnonzero(root != np.arange(len(nodes)))
        return np.stack([nodes[far], nodes[root[far]]])

    def batch(edges_):
        return pa.RecordBatch.from_arrays([pa.array(edges_[0]), pa.array(edges_[1])], names=["u", "v"])

    return mapped(edges, run, "u bigint, v bigint")


def connected_components(edges: DataFrame, work: Workspace, rounds: int = 60, one_task: int = BATCH // 2) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node it reaches.

    `edges` has two bigint columns in any order and with any repeats; null ends and loops are ignored. Every step is a
    partial minimum by node and a join whose large side Spark may split, so a hub with a third of all edges needs no
    single task. Each round is written, which cuts the lineage; it ends when a round leaves only stars. Edges that no task could join
    with its own, if they are no more than `one_task`, are joined by one task at once; the result is the same.
    """
    a, b = (F.col(f"`{c}`").cast("bigint") for c in edges.columns[:2])
    now = work.save(_local_forest(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v and u is not null and v is not null")), "edges")
    if now.count() <= one_task:
        return _members(work.save(_local_forest(now.coalesce(1)), "edges"))
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.save(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low)
        new = work.save(small.distinct(), "edges")
        work.drop(large)
        work.drop(now)
        now = new
        # Stars only: every node has one edge, and no centre has an edge of its own.
        if not now.groupBy("u").count().where("count > 1").limit(1).count() and not now.select("u").join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count():
            return _members(now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _members(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
