"""Token counts with overlap resynchronisation, and the exact token ids that packing uses.

Ids are those of the byte-level BPE file that `path` names. Texts in common alphabets take a second library that
holds the same vocabulary as ranks and is about four times as fast. Both merge the pair of lowest rank first, so within a
piece of the pre-tokenizer they agree; the pre-tokenizers could differ only in how they class rare characters, so a text
with any `RARE` character goes to the first library.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from fieldweave.llm.common import lean, map_rows, need, utf8_view

VOCABULARY = "byte_bpe_50k"
# Fixed values of the vocabulary file: its added token and that token's id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Characters whose class (letter, digit, space, other) all Unicode versions share.
RARE = re.compile(r"[^\x00-\x1b\x20-\x7f\xa0-ɏ‐-‧€]")
#: A boundary that holds in any context: no piece of the pre-tokenizer runs from a visible character into white space.
STABLE = re.compile(r"(?<=[!-~¡-ɏ])(?=[ \n])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


@lru_cache(maxsize=4)
def _library(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _ranks(path: str):
    """The same vocabulary as ranks, if it lies beside the file."""
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    widths = np.zeros(max(ranks.values()) + 2, np.int64)
    for k, v in ranks.items():
        widths[v] = len(k)
    widths[SPECIAL_ID] = len(SPECIAL)
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), widths


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of the whole text, as the library gives them without begin or end tokens."""
    if not text.isascii() and RARE.search(text):
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)
    encode = _ranks(path)[0].encode_ordinary
    if SPECIAL not in text:
        return np.array(encode(text), np.uint32)
    ids: list[int] = []
    for k, part in enumerate(text.split(SPECIAL)):
        ids += ([SPECIAL_ID] if k else []) + encode(part)
    return np.array(ids, np.uint32)


def token_ends(text: str, path: str) -> np.ndarray:
    """Where each token of the text ends, in UTF-8 bytes; tokens that share a rare text's character end where it does."""
    if not text.isascii() and RARE.search(text):
        spans = _library(path).encode(text, add_special_tokens=False).offsets
        width = np.r_[0, np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])]
        return width[np.array([e for _, e in spans], np.int64)]
    return np.cumsum(_ranks(path)[1][token_ids(text, path)])


def count_resynchronised(text: str, path: str, chunk: int, overlap: int) -> int:
    """Tokens of a huge text from overlapping chunks.

    A chunk is encoded with offsets. Two neighbours are spliced at a position in their overlap where both have a token
    boundary and the characters around it prove that every encoding of the whole text has one (`STABLE`): what stands
    left of it is counted in the left chunk, what stands right in the right one. Where an overlap has none, the left
    chunk grows, and its overlap doubles, until there is one or the text ends.
    """
    total, start, n = 0, 0, len(text)
    while True:
        size, over = chunk, overlap
        while True:
            end = min(n, start + size)
            left = text[start:end]
            ends = token_ends(left, path)
            if end == n:
                return total + len(ends)
            cut = _common_boundary(text, left, ends, start, end, over, path)
            if cut is not None:
                total, start = total + cut[0], cut[1]
                break
            size, over = size + over, over * 2


def _common_boundary(text, left, ends, start, end, over, path):
    """Tokens of the left chunk before the splice, and the splice's place in the text."""
    begin = max(start + 1, end - over)
    right_ends = token_ends(text[begin : min(len(text), end + over)], path)
    at = len(left[: begin - start].encode("utf-8", "surrogatepass"))
    guard = len(SPECIAL)  # a special token that the cut divides is not seen
    for m in reversed(list(STABLE.finditer(text, begin + guard, max(begin + guard, end - guard)))):
        p = m.start()
        here = len(text[begin:p].encode("utf-8", "surrogatepass"))
        i, j = np.searchsorted(ends, at + here, side="right"), np.searchsorted(right_ends, here, side="right")  # after all tokens of a character
        if i and ends[i - 1] == at + here and j and right_ends[j - 1] == here:
            return int(i), p
    return None


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024, chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """One row for each row of `docs`: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Equal ids, repeated rows and null ids stay as they are; an empty
    table gives an empty result. `chunk` and `overlap` are in characters; texts up to one chunk are encoded whole.
    """
    path = path or vocabulary_path()
    src = need(docs, id_col, text_col)

    @lean
    def run(batches):
        for b in batches:
            _, off = utf8_view(b.column(1))
            counts = np.zeros(b.num_rows, np.int64)
            for i, value in enumerate(b.column(1)):
                text = value.as_py()
                if text:
                    counts[i] = len(token_ids(text, path)) if len(text) <= chunk else count_resynchronised(text, path, chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(counts), pa.array(counts > limit)], names=["_0", "_1", "_2", "_3"])

    return map_rows(src, run, StructType([src.schema[id_col], StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]))
