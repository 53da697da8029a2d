"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from fieldweave.llm.common import crc32_of, lean, map_rows, need, runs_of, span_hash, utf8_view

# Classes of bytes that the features count.
LOWER, UPPER, HIGH, DIGIT, SPACE, STOP, BANG, BAR, SYMBOL = range(9)
CLASS = np.full(256, SYMBOL, np.int64)
CLASS[ord("a") : ord("z") + 1] = LOWER
CLASS[ord("A") : ord("Z") + 1] = UPPER
CLASS[0x80:] = HIGH
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
CLASS[[ord(c) for c in ".,;:'\"?-()"]] = STOP
CLASS[ord("!")] = BANG
CLASS[ord("|")] = BAR


def line_features(data: np.ndarray, off: np.ndarray):
    """Lines of a run of texts: (document of each line, its bytes, features with those of both neighbours)."""
    n = len(off) - 1
    breaks = np.flatnonzero(data == 0x0A)
    start = np.r_[off[:-1], breaks + 1]
    doc = np.r_[np.arange(n), np.searchsorted(off, breaks, side="right") - 1]
    by = np.lexsort((start, doc))
    start, doc = start[by], doc[by]
    last = np.r_[doc[1:] != doc[:-1], True]
    end = np.where(last, off[doc + 1], np.r_[start[1:], 0] - 1)
    m, size = len(start), end - start
    line = np.repeat(np.arange(m), size)
    where = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    kind = CLASS[data[where]] if len(where) else np.zeros(0, np.int64)
    counts = np.bincount(line * 9 + kind, minlength=m * 9).reshape(m, 9)
    solid = kind != SPACE
    first = solid & ~(np.r_[False, solid[:-1]] & np.r_[False, line[1:] == line[:-1]]) if m and len(line) else np.zeros(0, bool)
    words = np.bincount(line[first], minlength=m) if len(line) else np.zeros(m)
    shout = np.bincount(line[first & (kind == UPPER)], minlength=m) if len(line) else np.zeros(m)
    code = span_hash(data, start, size)
    _, back, times = np.unique(np.stack([doc.astype(np.uint64), code]), axis=1, return_inverse=True, return_counts=True) if m else (None, np.zeros(0, np.int64), np.zeros(0))
    repeated = (times[back.ravel()] > 1) & (size > 0) if m else np.zeros(0, bool)
    per = counts / np.maximum(size, 1)[:, None]
    letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, HIGH]
    own = np.c_[
        np.log1p(size) / 6, per[:, [DIGIT, SPACE, STOP]] * 4, np.minimum(per[:, [BANG, BAR, SYMBOL]] * 12, 3), counts[:, UPPER] / np.maximum(letters, 1) * 2,
        np.log1p(words) / 4, np.minimum(size / np.maximum(words, 1), 30) / 10, shout / np.maximum(words, 1), repeated, size == 0,
    ].astype(np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if m:
        same = ~last[:-1]
        before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    lone = np.c_[np.r_[True, last[:-1]], last] if m else np.zeros((0, 2))
    return doc, size, np.c_[own, before, after, lone, np.ones(m)]


class LineField:
    """Two labels, bad and good. A line's features give the log odds of good; `step` holds the log weights of label pairs."""

    def __init__(self, weights: np.ndarray, step: np.ndarray, scale: np.ndarray):
        self.weights, self.step, self.scale = weights, step, scale

    def marginals(self, odds: np.ndarray, doc: np.ndarray):
        """Forward-backward in log space over all documents at once, one line of each at a time.

        Returns the probability of good for every line, the sum over lines of pair marginals, and the log partition sums.
        """
        m = len(odds)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if m else np.zeros(0, np.int64)
        length = np.diff(np.r_[first, m])
        by = np.argsort(-length, kind="stable")
        first, length = first[by], length[by]
        emit = np.c_[np.zeros(m), odds]
        alpha, beta = np.zeros((m, 2)), np.zeros((m, 2))
        active = np.searchsorted(-length, -np.arange(1, (length[0] if m else 0) + 1), side="right")
        for t, k in enumerate(active):
            at = first[:k] + t
            alpha[at] = emit[at] + (np.logaddexp(alpha[at - 1, :1] + self.step[0], alpha[at - 1, 1:] + self.step[1]) if t else 0)
        for t in range(len(active) - 2, -1, -1):
            at = first[: active[t + 1]] + t
            ahead = emit[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(self.step[:, 0] + ahead[:, :1], self.step[:, 1] + ahead[:, 1:])
        ends = first + length - 1
        z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
        full = np.empty(m)
        full[np.repeat(first, length) + (np.arange(m) - np.repeat(np.cumsum(length) - length, length))] = np.repeat(z, length)
        good = np.exp(alpha[:, 1] + beta[:, 1] - full)
        inner = np.flatnonzero(np.r_[False, doc[1:] == doc[:-1]]) if m else np.zeros(0, np.int64)
        pairs = np.exp(alpha[inner - 1][:, :, None] + self.step[None] + (emit[inner] + beta[inner])[:, None, :] - full[inner][:, None, None]).sum(axis=0)
        return good, pairs, z.sum()

    def quality(self, x: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        """The share of good text by document, lines weighted by their length, as log odds turned into a probability."""
        good, _, _ = self.marginals(x @ self.weights, doc)
        weight = size + 1.0
        share = np.bincount(doc, good * weight, minlength=n) / np.maximum(np.bincount(doc, weight, minlength=n), 1)
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.scale[0] * np.log(share / (1 - share)) + self.scale[1])))


def train(x: np.ndarray, doc: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = 250, ridge: float = 2e-3) -> LineField:
    """Maximum likelihood with every line carrying its document's label, then a logistic scale for the documents' shares.

    Long documents would drown short ones, so a document counts by the inverse root of its lines.
    """
    n = len(label)
    if not n or label.min() == label.max():
        rate = (label.sum() + 1) / (n + 2) if n else 0.5
        return LineField(np.zeros(x.shape[1]), np.zeros((2, 2)), np.array([0.0, np.log(rate / (1 - rate))]))
    y = label[doc].astype(float)
    lines = np.bincount(doc, minlength=n)
    weight = (1 / np.sqrt(lines))[doc]
    w, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.r_[False, doc[1:] == doc[:-1]]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[doc[inner]], label[doc[inner]]), 1)
    m1, m2, s1, s2 = np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))
    model = LineField(w, step, np.array([1.0, 0.0]))
    for k in range(1, rounds + 1):
        good, pairs, _ = model.marginals(x @ w, doc)
        gw = -(x.T @ ((y - good) * weight)) / weight.sum() + ridge * w
        gs = -(seen - pairs) / max(1, inner.sum()) + 0.05 * step
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        s1, s2 = 0.9 * s1 + 0.1 * gs, 0.99 * s2 + 0.01 * gs * gs
        w -= 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-9)
        step -= 0.02 * (s1 / (1 - 0.9**k)) / (np.sqrt(s2 / (1 - 0.99**k)) + 1e-9)
    share = model.quality(x, doc, size, n)  # scale is still 1, 0
    z, a, b = np.log(share / (1 - share)), 0.5, 0.0
    for _ in range(100):  # Newton steps of a logistic fit
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((p - label) * z).sum() + 1e-3 * a, (p - label).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum()]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return LineField(w, step, np.array([max(a, 1e-3), b]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 6_000, most_lines: int = 2_000) -> LineField:
    """Learn from labelled rows whose crc32(id) mod 5 is not 0.

    At most `most` labels are used, chosen by a hash of the id; only the features of their documents come to the driver. Of a document of
    more than `most_lines` lines the fit sees that many, in stretches of 20 spread evenly over it. A document with several labels counts with the smaller. Labels other than 0 and 1 are ignored. Ids may be of any type
    that both tables share.
    """
    spark = docs.sparkSession
    rows = need(labels, id_col, label_col).toDF("id", "label").where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (crc32_of("id") % 5 != 0))
    chosen = rows.groupBy("id").agg(F.min("label").cast("int").alias("label")).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(most).collect()
    chosen = spark.createDataFrame([(r["id"], r["label"]) for r in chosen], StructType([rows.schema["id"], StructField("label", IntegerType())]))
    src = need(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(chosen), "id").select("text", "label")

    @lean
    def run(batches):
        for b in batches:
            data, off = utf8_view(b.column(0))
            labels_ = b.column(1).to_pylist()
            for i, j in runs_of(off, 4 << 20):
                doc, size, x = line_features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for d in range(j - i):
                    own = np.flatnonzero(doc == d)
                    if len(own) > most_lines:  # whole stretches of 20 lines, so that neighbours stay neighbours
                        stretches = np.linspace(0, len(own) // 20 - 1, most_lines // 20).astype(np.int64)
                        own = own[(stretches[:, None] * 20 + np.arange(20)).ravel()]
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array([labels_[i + d]], pa.int32()), pa.array([size[own].tolist()], pa.list_(pa.int64())), pa.array([x[own].ravel().tolist()], pa.list_(pa.float64()))], names=["label", "size", "x"])

    t = src.mapInArrow(run, "label int, size array<bigint>, x array<double>").toArrow()
    sizes = [np.array(v, np.int64) for v in t.column("size").to_pylist()]
    doc = np.repeat(np.arange(len(sizes)), [len(s) for s in sizes])
    width = len(line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[2][0])
    x = np.concatenate([np.array(v) for v in t.column("x").to_pylist()]).reshape(-1, width) if len(sizes) else np.zeros((0, width))
    return train(x, doc, np.concatenate(sizes) if len(sizes) else np.zeros(0), np.array(t.column("label").to_pylist(), np.int64))


def score(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row for each row of `docs`: id, held_out, score, predicted.

    The score is the length-weighted mean over the lines of the probability that the line is good, on the scale of document labels.
    A null or empty text is one empty line. With labels of one kind, or none, the score is their smoothed rate. Null ids are not held
    out; repeated rows stay; an empty table gives an empty result; other columns are not read. A very long text is scored whole, and
    held whole by its task.
    """
    src = need(docs, id_col, text_col).withColumn("held_out", F.coalesce(crc32_of(id_col) % 5 == 0, F.lit(False)))

    @lean
    def run(batches):
        for b in batches:
            data, off = utf8_view(b.column(1))
            out = [np.zeros(0)]
            for i, j in runs_of(off, 1 << 20):
                doc, size, x = line_features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                out.append(model.quality(x, doc, size, j - i))
            s = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["_0", "_1", "_2", "_3"])

    return map_rows(src, run, StructType([src.schema[id_col], StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
