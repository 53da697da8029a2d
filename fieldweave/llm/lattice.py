"""SentencePiece segmentations sampled from the piece lattice by forward filtering and backward sampling, and lossless decoding."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from fieldweave.llm.common import MASK, U64, PrefixHash, eights, gather, lean, map_rows, mix64, need, runs_of, same_spans, span_hash, utf8_view

MODEL = "piece_bpe_32k"
PIECES = StructField("pieces", ArrayType(IntegerType()))
_hash = PrefixHash(5)
ODD = U64(0x9E3779B97F4A7C15)  # times this, 64-bit values spread and stay distinct


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.model")


class Pieces:
    """The model's pieces as bytes, with a space for the space mark, and a log probability for each.

    The file has merge ranks, not probabilities; a piece of rank r gets that of the r-th word under Zipf's law, shifted by `shift`.
    Pieces that would cross a boundary of chunks (space after something else, or a line end) aren't used.
    """

    def __init__(self, path: str, shift: float = 10.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        by_size: dict[int, list[int]] = {}
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[1:-1], 16)
                self.bytes[i], self.byte_id[value] = bytes([value]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                b = sp.id_to_piece(i).replace("▁", " ").encode()
                self.bytes[i] = b
                if b" " not in b.lstrip(b" ") and b"\n" not in b:
                    by_size.setdefault(len(b), []).append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte fallback")
        rank = np.maximum(0, -np.array([sp.get_score(i) for i in range(n)]))
        z = np.log(np.arange(n) + shift)
        self.logp = -np.log(rank + shift) - np.log(np.exp(-z).sum())
        self.logp[self.byte_id] = -np.log(n + shift) - np.log(np.exp(-z).sum())
        self.tables = {}
        for size, ids in sorted(by_size.items()):
            data = np.frombuffer(b"".join(self.bytes[i] for i in ids), np.uint8)
            start = np.arange(len(ids)) * size
            h = (eights(data)[start] & MASK[size]) * ODD if size <= 8 else _hash.span(_hash.prefix(data), start, start + size)
            by = np.argsort(h)
            seen = np.zeros(1 << 18, bool)  # most substrings are no piece; this tells at once
            seen[(h >> U64(46)).astype(np.int64)] = True
            slot = np.searchsorted(h[by] >> U64(48), np.arange(1 << 16, dtype=U64)).astype(np.int32)  # where values of these 16 bits begin
            self.tables[size] = h[by], np.array(ids)[by], seen, slot, int(np.bincount((h >> U64(48)).astype(np.int64)).max())
        self.size = np.array([len(b) for b in self.bytes])
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.cumsum(self.size) - self.size


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _lattice(data: np.ndarray, start: np.ndarray, size: np.ndarray, p: Pieces, alpha: float):
    """The lattices of distinct chunks. A node is a place before, between or after the bytes of a chunk.

    Returns the end node of each chunk and, with arcs ordered by their end, where each arc comes from, its piece, and the running sum
    of node + share of the forward sums: where node + u falls among these, for u in [0, 1), is the arc to go back by.
    """
    n = len(start)
    text = data[gather(start, size)]
    base = np.cumsum(size + 1) - (size + 1)  # node of each chunk's start
    first = np.cumsum(size) - size  # its first byte in text
    chunk = np.repeat(np.arange(n), size)
    place = np.arange(len(text)) - first[chunk]
    left = size[chunk] - place
    head = (text & 0xC0) != 0x80  # a character's first byte
    width = np.ones(len(text), np.int64)
    width[text >= 0xC0], width[text >= 0xE0], width[text >= 0xF0] = 2, 3, 4
    whole = np.zeros(len(text), bool)  # characters that are pieces
    froms, ids, lens = [], [], []
    heads = np.flatnonzero(head)  # where a piece of the length at hand, or a longer one, can start
    room, word, prefix = left[heads], eights(text)[heads], None
    for length, (hashes, who, seen, slot, crowd) in p.tables.items():
        fits = np.flatnonzero(room >= length)
        if len(fits) < len(heads):
            heads, room, word = heads[fits], room[fits], word[fits]
        if not len(heads):
            break
        if length <= 8:
            h = (word & MASK[length]) * ODD
        else:
            prefix = _hash.prefix(text) if prefix is None else prefix
            h = _hash.span(prefix, heads, heads + length)
        maybe = np.flatnonzero(seen[(h >> U64(46)).astype(np.int64)])
        s, h = heads[maybe], h[maybe]
        at = slot[(h >> U64(48)).astype(np.int64)].astype(np.int64)
        for _ in range(crowd - 1):
            at += hashes[np.minimum(at, len(hashes) - 1)] < h
        at = np.minimum(at, len(hashes) - 1)
        hit = np.flatnonzero(hashes[at] == h)
        s, at = s[hit], at[hit]
        if length > 8:
            hit = same_spans(text, s, p.pool, p.at[who[at]], np.full(len(s), length))  # equal hashes only propose; up to 8 bytes they are the bytes
            s, at = s[hit], at[hit]
        whole[s[width[s] == length]] = True
        froms.append(s)
        ids.append(who[at])
        lens.append(np.full(len(s), length))
    own = np.maximum.accumulate(np.where(head, np.arange(len(text)), 0)) if len(text) else np.zeros(0, np.int64)
    lone = np.flatnonzero(~whole[own])  # bytes of the others
    froms.insert(0, lone)
    ids.insert(0, p.byte_id[text[lone]])
    lens.insert(0, np.ones(len(lone), np.int64))
    s, ids, lens = (np.concatenate(x[::-1]) for x in (froms, ids, lens))  # longest first: arcs of one end come by their source
    by = np.argsort(s + chunk[s] + lens, kind="stable")  # a merge, as each length is in order already
    s, ids, lens = s[by], ids[by], lens[by]
    source = s + chunk[s]  # a chunk has one node more than bytes
    end = source + lens
    level = place[s] + lens
    logp = alpha * p.logp[ids]
    most = int(size.max()) if n else 0
    step = np.argsort(level.astype(np.uint16) if most < 1 << 16 else level, kind="stable")  # by counting, if numbers are small
    nodes = int((size + 1).sum())
    forward = np.full(nodes, -np.inf)
    forward[base] = 0
    share = np.empty(len(source))
    cuts = np.r_[0, np.cumsum(np.bincount(level, minlength=most + 1)[1:])]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # forward filtering, all chunks at once
        if a == b:
            continue
        arcs = step[a:b]
        value, e = forward[source[arcs]] + logp[arcs], end[arcs]
        seg = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
        total = np.logaddexp.reduceat(value, seg)
        forward[e[seg]] = total
        share[arcs] = np.exp(value - np.repeat(total, np.diff(np.r_[seg, b - a])))
    running = np.cumsum(share)
    seg = np.flatnonzero(np.r_[True, end[1:] != end[:-1]]) if len(end) else np.zeros(0, np.int64)
    count = np.diff(np.r_[seg, len(end)])
    running -= np.repeat(running[seg] - share[seg], count)
    last = seg + count - 1
    running[last] = 1.0
    final = np.zeros(nodes, np.int64)
    final[end[seg]] = last
    return base + size, base, source, ids, end + np.minimum(running, 1.0), final


def encode_texts(texts, keys: np.ndarray, p: Pieces, alpha: float = 0.7, seed: int = 0, step: int = 1 << 20):
    """Piece ids of a column of texts: (offsets, ids). keys: one 64-bit value for each row."""
    data, off = utf8_view(texts)
    counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in runs_of(off, step):
        c, k = _encode(data[off[i] : off[j]], off[i : j + 1] - off[i], keys[i:j], p, alpha, seed)
        counts.append(c)
        ids.append(k)
    return np.r_[0, np.cumsum(np.concatenate(counts))], np.concatenate(ids)


def _side_by_side(data, start, size):
    """An order in which equal chunks stand side by side, so that what follows stays in the cache, and where each distinct one begins.

    Hashes make the order; bytes confirm it, and make another one if two different chunks share a hash.
    """
    h = span_hash(data, start, size)
    by = np.argsort(h)
    new = np.r_[True, h[by][1:] != h[by][:-1]]
    one = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    if not ((size[by] == size[one]).all() and same_spans(data, start[by], data, start[one], size[by]).all()):
        number: dict[bytes, int] = {}
        kind = np.array([number.setdefault(data[a : a + n].tobytes(), len(number)) for a, n in zip(start.tolist(), size.tolist(), strict=True)])
        by = np.argsort(kind, kind="stable")
        new = np.r_[True, kind[by][1:] != kind[by][:-1]]
    return by, new


def _encode(data, off, keys, p, alpha, seed):
    n = len(off) - 1
    filled = np.flatnonzero(off[1:] > off[:-1])
    data = np.insert(data, off[filled], 0x20)  # the prefix that the model's texts have
    width = np.diff(off) + (np.diff(off) > 0)
    off = np.r_[0, np.cumsum(width)]
    if not len(data):
        return np.zeros(n, np.int64), np.zeros(0, np.int64)
    space, line = data == 0x20, data == 0x0A
    cut = np.r_[True, (space[1:] & ~space[:-1]) | line[1:] | line[:-1]]
    cut[off[filled]] = True
    start = np.flatnonzero(cut)  # chunks: pieces never cross these places
    size = np.diff(np.r_[start, len(data)])
    doc = np.searchsorted(off, start, side="right") - 1
    nth = np.arange(len(start)) - np.searchsorted(start, off[doc])
    by, new = _side_by_side(data, start, size)
    start, size, doc, nth = start[by], size[by], doc[by], nth[by]
    one, kind = np.flatnonzero(new), np.cumsum(new) - 1
    ends, base, source, piece, running, final = _lattice(data, start[one], size[one], p, alpha)
    bottom = base[kind]
    node = ends[kind].copy()
    draw = mix64(keys.view(U64)[doc] + U64(seed)) + mix64(nth.astype(U64) + U64(1))
    live, taken, level = np.arange(len(start)), [], 0
    many = np.zeros(len(start), np.int64)
    while len(live):  # backward sampling, all chunks of all texts at once
        u = (mix64(draw[live] + U64(level * 0x9E3779B97F4A7C15 % 2**64)) >> U64(11)).astype(np.float64) / 2**53
        arc = np.minimum(np.searchsorted(running, node[live] + u, side="right"), final[node[live]])
        taken.append((live, arc))
        node[live] = source[arc]
        many[live] += 1
        live = live[node[live] > bottom[live]]
        level += 1
    total = np.empty(len(many), np.int64)
    total[by] = many
    last = (np.cumsum(total) - 1)[by]
    out = np.empty(int(many.sum()), np.int64)
    for k, (who, arc) in enumerate(taken):
        out[last[who] - k] = piece[arc]
    return np.bincount(doc, many, minlength=n).astype(np.int64), out


def decode_ids(off: np.ndarray, ids: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of rows of ids, without the prefix."""
    size = p.size[ids]
    data = p.pool[gather(p.at[ids], size)] if len(ids) else np.zeros(0, np.uint8)
    ends = np.r_[0, np.cumsum(size)][off]
    filled = ends[1:] > ends[:-1]
    keep = np.ones(len(data), bool)
    keep[ends[:-1][filled]] = False
    return data[keep], np.r_[0, np.cumsum(np.diff(ends) - filled)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, alpha: float = 0.7, seed: int = 0) -> DataFrame:
    """One row for each row of `docs`: id, pieces (ids of a segmentation drawn from the lattice), decoded_sha256 (of the text that these
    ids decode to, so that a round trip can be checked without a second pass).

    The probability of a segmentation is the product of its pieces' to the power `alpha`: 0 draws evenly, a large value gives the best
    one. The draw depends on the row's id, `seed`, the chunk's place and the step alone, so it is the same in every run and layout;
    rows with equal ids and texts get equal draws. Characters that are no piece are spelt in bytes, a literal space mark too, so
    decode() gives the text back exactly. Null and empty texts have no pieces. An empty table gives an empty result.
    """
    path = path or model_path()
    src = need(docs, id_col, text_col).withColumn("key", F.xxhash64(F.col(f"`{id_col}`")))

    @lean
    def run(batches):
        p = load(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                off, ids = encode_texts(part.column(1), part.column(2).to_numpy(), p, alpha, seed)
                text, ends = decode_ids(off, ids, p)
                digests = [hashlib.sha256(text[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(digests, pa.string())], names=["_0", "_1", "_2"])

    return map_rows(src, run, StructType([src.schema[id_col], PIECES, StructField("decoded_sha256", StringType())]))


def decode(encoded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", path: str | None = None) -> DataFrame:
    """id, pieces, text of rows of piece ids; null pieces count as none, and give the empty text. Control pieces have no text."""
    path = path or model_path()
    src = need(encoded, id_col, pieces_col)

    @lean
    def run(batches):
        p = load(path)
        for b in (whole.slice(i, 128) for whole in batches for i in range(0, whole.num_rows, 128)):
            col = b.column(1)
            off = np.r_[0, np.cumsum([0 if v is None else v for v in pc.list_value_length(col).to_pylist()])]
            data, ends = decode_ids(off, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), p)
            text = pa.StringArray.from_buffers(b.num_rows, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), col, text], names=["_0", "_1", "_2"])

    return map_rows(src, run, StructType([src.schema[id_col], PIECES, StructField("text", StringType())]))
