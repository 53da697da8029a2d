"""Embeddings of texts behind an interface; the default needs no model file."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], np.ndarray]
WIDTH = 384


def hashed_ngrams(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """Unit vectors of hashed character 2- to 4-grams of the lower-case text, spaces and underscores alike."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in zip(out, texts, strict=True):
        if not (text or "").strip():
            continue
        t = f" {' '.join(text.lower().replace('_', ' ').split())} "
        for n in (2, 3, 4):
            for i in range(len(t) - n + 1):
                h = zlib.crc32(t[i : i + n].encode())
                row[h % width] += 1.0 if h & 0x10000 else -1.0
        size = float(np.linalg.norm(row))
        if size:
            row /= size
    return out


def with_embeddings(df: DataFrame, text_col: str, embedder: Embedder = hashed_ngrams, out: str = "embedding") -> DataFrame:
    """`df` with the vectors of `text_col` in column `out`, one call of the embedder for each batch."""
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            m = np.asarray(embedder([x or "" for x in b.column(at).to_pylist()]), np.float32)
            off = pa.array(np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] if len(m) else 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(off, pa.array(m.ravel()))], names=[*b.schema.names, out])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))
