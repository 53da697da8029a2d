"""MinHash near-duplicates: banded candidates, odd sketches to estimate them, full sets to confirm them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import U64, Workspace, gather, lean, mapped, mix64, need, runs_of
from fieldweave.llm.components import connected_components
from fieldweave.llm.shingles import exact_counts, shingle_sets, word_digests

SAMPLES, BANDS = 128, 32
BINS, BITS = 4096, 2048  # samples that an odd sketch folds, and its width
_rng = np.random.default_rng(5_125_120)
_a = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_b = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_row = _rng.integers(0, 2**63, SAMPLES // BANDS, dtype=U64) * U64(2) + U64(1)


def minhash(s: np.ndarray) -> np.ndarray:
    """The least value of each of the sample functions over a set of 64-bit values."""
    x = (s >> U64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        h = np.multiply.outer(_a, x[i : i + 2048])
        h += _b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def odd_sketch(s: np.ndarray) -> tuple[np.ndarray, int]:
    """The parity bitmap of a set as 64-bit words, and how many samples it folds.

    One permutation gives all samples: the set, already even 64-bit values in order, falls into BINS by leading bits, and the least value
    of each bin that isn't empty is its sample. Each flips one of BITS bits. Small sets are kept nearly whole this way.
    """
    top = s >> U64(52)
    least = s[np.r_[True, top[1:] != top[:-1]]] if len(s) else s
    flips = np.bincount((mix64(least) >> U64(53)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(U64), len(least)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a row of samples; bands don't share keys."""
    rows = samples.reshape(len(samples), BANDS, -1).astype(U64)
    return mix64((mix64(rows + U64(1)) * _row).sum(axis=2, dtype=U64) + np.arange(BANDS, dtype=U64))


def most_odd(j: float, na, nb, sa, sb, sigmas: float = 5.0, m=np):
    """The population count of two XORed sketches that a pair of similarity j exceeds only beyond `sigmas` deviations.

    na, nb: set sizes; sa, sb: samples folded. `m` is numpy, or pyspark.sql.functions for columns.
    """
    union = (na + nb) / (1 + j)
    fill = m.exp(-union / BINS)
    # Bins used by the union: as many as expected, by the factor by which both sets fill more or fewer than expected.
    used = BINS * (1 - fill) * (sa + sb) / (BINS * (2 - m.exp(-na / BINS) - m.exp(-nb / BINS)))
    differ = sa + sb - 2 * j * used
    differ = m.greatest(differ, m.lit(0.0)) if m is F else np.maximum(differ, 0)
    spread = 4 * used * j * (1 - j) * (1 - BINS * (1 - fill) / union) + 4 * j * j * BINS * fill * (1 - (1 + union / BINS) * fill)
    # In bins that few share, only what differs can stray, and only where it shares a bin.
    light = 2 * (na + nb) * ((1 - j) / (1 + j)) * (1 - fill)
    spread = m.least(spread, light) if m is F else np.minimum(spread, light)
    q = m.exp(-2.0 / BITS * differ)
    noise = BITS / 4 * (1 - q * q) - differ * q * q
    both = q * q * spread + noise
    both = m.greatest(both, m.lit(0.0)) if m is F else np.maximum(both, 0)
    return BITS / 2 * (1 - q) + sigmas * m.sqrt(both) + 1


def similarity_of(odd: int, sa: int, sb: int, na: int, nb: int) -> float:
    """The similarity that the population count of two XORed sketches speaks for."""
    differ = -BITS / 2 * math.log(max(1e-9, 1 - 2 * odd / BITS))
    same = max(0.0, (sa + sb - differ) / 2)
    j = same / max(1.0, sa + sb - same)
    for _ in range(30):
        j = min(1.0, same / (BINS * (1 - math.exp(-(na + nb) / (1 + j) / BINS))))
    return j


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    @lean
    def run(batches):
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            n, samples, odd, used = [], [], [], []
            for s in shingle_sets(b.column(1), words):
                n.append(len(s))
                samples.append(minhash(s))
                sketch, m = odd_sketch(s)
                odd.append(sketch)
                used.append(m)
            if not n:
                continue
            key = np.frombuffer(b"".join(word_digests(b.column(1))), np.int64).reshape(-1, 2)
            bands = band_keys(np.array(samples, np.uint32)).astype(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel())) for x in (bands, np.array(odd, U64).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(used, pa.int32()), pa.array(key[:, 0]), pa.array(key[:, 1]), *lists], names=["id", "n", "used", "k1", "k2", "bands", "sketch"])

    return mapped(docs, run, "id bigint, n bigint, used int, k1 bigint, k2 bigint, bands array<bigint>, sketch array<bigint>")


def _odd(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(1, BITS // 64)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def _near(a: Column, b: Column, parts: int, whole: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(a, b) * whole >= F.greatest(a, b) * parts


def _texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, t): one text for each id of the pairs, and perhaps of others.

    Texts are read anew, but only those of ids that a bitmap of fixed size (2**22 bits, 0.5 MB) lets through; joins
    then decide, so a full bitmap costs time, not results.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << 22))
    words64 = ids.select(bit.alias("x")).groupBy((F.col("x") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x % 64 as int))")).alias("m"))
    bitmap = np.zeros(1 << 16, np.int64)
    for r in words64.collect():  # 65,536 rows at most
        bitmap[r["w"]] = r["m"]
    bits = bitmap.view(np.uint8)

    @lean
    def wanted(batches):
        for b in batches:
            x = b.column(2).to_numpy()
            b = b.filter(pa.array((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.binary())], names=["id", "t"])

    return docs.withColumn("x", F.pmod(F.xxhash64("id"), F.lit(1 << 22))).mapInArrow(wanted, "id bigint, t binary").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, parts: int, whole: int) -> DataFrame:
    """The pairs (a, b) whose full sets, compared by their words, are similar enough. `texts` is a table, so that Spark may split a hub's pairs."""

    @lean
    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                n, m, both = exact_counts(x.as_py(), y.as_py(), words)
                keep.append(both * whole >= (n + m - both) * parts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    two = one.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    return two.select("a", "b", "ta", "tb").mapInArrow(compare, "a bigint, b bigint")


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """Rows (key, pos, id, c, n) dealt into cells of at most `block` members and `block` queries: cell, ask, pos, id, c, main.

    Only pairs of different components matter. So in each bucket the largest component's rows are members only; all rows of the others
    are queries too. Sets of similar size fall into the same or neighbouring size classes, so a query visits three classes.
    """
    rows = rows.withColumn("s", F.floor(F.log("n") / math.log(4 / 3)).cast("int"))
    sizes = rows.groupBy("key", "s", "c").agg(F.count("*").alias("m"))
    mains = sizes.groupBy("key", "c").agg(F.sum("m").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"))
    sizes = sizes.join(mains, "key")
    classes = F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1))
    asked = sizes.where("c <> main").select("key", classes.alias("s"), "m").groupBy("key", "s").agg(F.ceil(F.sum("m") / block).cast("int").alias("qb"))
    shape = sizes.groupBy("key", "s", "main").agg(F.ceil(F.sum("m") / block).cast("int").alias("mb")).join(asked, ["key", "s"])
    member = rows.join(shape, ["key", "s"]).withColumns({"mine": F.pmod(F.xxhash64("id"), "mb").cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("qb") - 1)), "ask": F.lit(0)})
    query = rows.join(mains, "key").where("c <> main").drop("main").withColumn("s", classes).join(shape, ["key", "s"])
    query = query.withColumns({"mine": F.explode(F.sequence(F.lit(0), F.col("mb") - 1)), "other": F.pmod(F.xxhash64("id"), "qb").cast("int"), "ask": F.lit(1)})
    cell = F.xxhash64("key", "s", "mine", "other").alias("cell")
    return member.select(cell, "ask", "pos", "id", "c", (F.col("c") == F.col("main")).cast("int").alias("main")).unionByName(query.select(cell, "ask", "pos", "id", "c", F.lit(0).alias("main")))


def _cell_pairs(rows: DataFrame, parts: int, whole: int) -> DataFrame:
    """Pairs of a query and a member of its cell, of different components, whose sketches are near.

    Rows (cell, ask, pos, id, c, main, n, used, sketch, bands) come sorted by cell. What is held is one batch and one cell; only pairs
    that pass leave the task, and only from the first band (`pos`) whose key they share.
    """

    @lean
    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            cell = t.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if cut:
                yield from compare(t.slice(0, cut))
                t = t.slice(cut)
            held = t if t.num_rows else None
        if held is not None:
            yield from compare(held)

    def compare(t):
        cell, ask, pos, ids, c, main, n, used = (t.column(k).to_numpy() for k in ("cell", "ask", "pos", "id", "c", "main", "n", "used"))
        sketch, bands = (pa.concat_arrays(t.column(k).chunks).flatten().to_numpy().view(U64).reshape(len(ids), -1) for k in ("sketch", "bands"))
        q = np.flatnonzero(ask == 1)
        first, last = np.searchsorted(cell, cell[q]), np.searchsorted(cell, cell[q], side="right")
        found = set()
        for i, j in runs_of(np.r_[0, np.cumsum(last - first)], 1 << 14):
            y = gather(first[i:j], (last - first)[i:j])
            x = np.repeat(q[i:j], (last - first)[i:j])
            # Two queries meet in both directions; the one with the smaller id asks.
            ok = (ask[y] == 0) & (c[x] != c[y]) & ((main[y] == 1) | (ids[x] < ids[y])) & (np.minimum(n[x], n[y]) * whole >= np.maximum(n[x], n[y]) * parts)
            x, y = x[ok], y[ok]
            ok = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1) <= most_odd(parts / whole, n[x], n[y], used[x], used[y])
            x, y = x[ok], y[ok]
            ok = (bands[x] == bands[y]).argmax(axis=1) == pos[x]
            found.update(zip(np.minimum(ids[x], ids[y])[ok].tolist(), np.maximum(ids[x], ids[y])[ok].tolist(), strict=True))
            if len(found) > 65536:
                yield batch(found)
                found = set()
        if found:
            yield batch(found)

    def batch(found):
        a = np.array(sorted(found), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, parts: int = 75, whole: int = 100, block: int = 128) -> DataFrame:
    """One row for each row of `docs`: id, n_shingles, component_id, kept.

    Two documents are linked if their sets of distinct word shingles have `whole` * intersection >= `parts` * union.
    Documents with equal sequences of words are one class and stand for each other. For classes, equal keys in one of 32 bands of 4 MinHash values
    make a candidate: at the least similarity linked, one pair in 200,000 has none in common. First every class is compared
    with the smallest id of each of its buckets; the nearest by sketch is confirmed on full sets, and what is linked is contracted.
    Then each bucket's rows outside its largest component are compared by sketch with all others of similar size, in cells of at most
    `block` of either, and those near enough confirmed. Pairs that already are in one component add nothing to it and are left out, so
    a large group of copies costs as much as its members, not its pairs. Hashes only find candidates: documents are one class by a
    128-bit digest of their words, and every link is confirmed on the words themselves.

    Null and empty texts, and texts of white space only, have no shingles and are linked with nothing. A row without an id is linked
    with nothing, has no component and is kept. Rows with equal ids count as one document. An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "minhash")
    src = need(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("bigint"))
    sig = work.save(_signatures(src, words), "signatures")
    key = ["n", "k1", "k2"]
    classes = sig.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"))
    classes = work.save(classes, "classes", thin=True)  # so that joins have shuffles of their own, whose hot keys Spark can split
    reps = work.save(sig.join(classes.select(*key, F.col("rep").alias("id")), [*key, "id"]).select("id", "n", "used", "bands", "sketch").distinct(), "representatives")
    light = reps.select("id", "n", "used", "sketch")
    rows = reps.select("id", F.explode("bands").alias("key"))
    low = rows.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1")
    stars = rows.join(low, "key").where("id > a").select("a", F.col("id").alias("b")).distinct()
    near = stars.join(light.toDF("a", "na", "sa", "ka"), "a").join(light.toDF("b", "nb", "sb", "kb"), "b").where(_near(F.col("na"), F.col("nb"), parts, whole))
    near = near.withColumn("d", _odd("ka", "kb")).where(F.col("d") <= most_odd(parts / whole, *(F.col(c) for c in ("na", "nb", "sa", "sb")), m=F))
    best = work.save(near.groupBy("b").agg(F.min(F.struct("d", "a")).alias("x")).select("x.a", "b"), "best", thin=True)
    texts = work.save(_texts_of(best, src), "texts")
    comp = connected_components(_confirmed(best, texts, words, parts, whole), work)
    work.drop(texts)

    rows = reps.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("c"), "n", F.posexplode("bands").alias("pos", "key"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    rows = work.save(rows.join(mixed, "key", "left_semi"), "mixed")  # the buckets that hold several components
    cells = _cells(rows, block).join(reps.select("id", "n", "used", "sketch", "bands"), "id").select("cell", "ask", "pos", "id", "c", "main", "n", "used", "sketch", "bands")
    more = work.save(_cell_pairs(cells, parts, whole).distinct(), "more", thin=True)
    texts = work.save(_texts_of(more, src), "texts")
    comp = connected_components(_confirmed(more, texts, words, parts, whole).union(comp.select("node", "component")), work)
    work.drop(texts)

    named = sig.join(classes, key, "left").select(F.col("id"), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("rep"))
    out = named.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
