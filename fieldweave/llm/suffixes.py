"""Removal of repeated byte strings by a hash-compared suffix sort around content-chosen anchors.

Every string of `length` bytes holds the anchor of its content: its k-gram of least hash. Equal strings have equal anchors at equal
offsets, so only strings around anchors that occur more than once can repeat. The steps:

1. Anchors of all texts are grouped by hash; those that occur once are forgotten.
2. The others fetch their surroundings, at most 2 * length - k bytes each, and meet again by hash.
3. There, the suffixes that start at equal anchors are sorted by a mergesort that compares two suffixes by binary search for their
   common extension over prefix polynomial hashes; so are the prefixes that end there, read backwards. The order and the extensions of
   neighbours are verified on the bytes; where a collision misled them, a plain sort of the bytes takes their place. Neighbours in
   both orders tell which strings around the anchors are equal.
4. Intervals go back to their texts.

Rows travel in compressed blocks, many to a row, in cells of a bounded number of bytes, one to a task. Equal surroundings are compared
once. Anchors with more than `hot` instances aren't brought together: their strings are sent one by one under a 128-bit BLAKE2 digest, after
equal ones of the same block of texts have been settled there, so that no key gathers more than one row for each block.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldweave.llm.common import U64, PrefixHash, Workspace, by_cell, lean, mapped, mix64, runs_of, same_spans, utf8_view
from fieldweave.operators.positions import with_positions

_hash = PrefixHash(71)
_LOW = U64((1 << 24) - 1)


def pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(struct.pack("<8sq", c.dtype.str.encode(), c.nbytes) + c.tobytes() for c in columns))


def unpack(block: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(raw):
        kind, size = struct.unpack_from("<8sq", raw, at)
        out.append(np.frombuffer(raw, kind.rstrip(b"\0").decode(), offset=at + 16, count=size // np.dtype(kind.rstrip(b"\0").decode()).itemsize))
        at += 16 + size
    return out


def unpack_all(blocks) -> list[np.ndarray]:
    parts = [unpack(b) for b in blocks]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    size, n = 1, len(x) - width + 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int, k: int):
    """(row, place, least offset, greatest offset, hash) of the anchors of all strings of `length` bytes within rows.

    An anchor serves the strings that start `offset` bytes before it, for all offsets in its range.
    """
    out = []
    for i, j in runs_of(off, 1 << 18):
        for a in range(off[i], max(off[i] + 1, off[j] - length + 1), 4 << 20):  # more than once only for a huge row
            b = min(off[j], a + (4 << 20) + length - 1) if j == i + 1 else off[j]
            out.append(_anchors(data[a:b], np.maximum(off[i : j + 1] - a, 0) if j > i + 1 else np.array([0, b - a]), length, k, i, a - off[i] if j == i + 1 else 0))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64)]


def _anchors(data, off, length, k, row, shift):
    n = len(data)
    if n < length:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64)]
    prefix = _hash.prefix(data)
    h = mix64((prefix[k:] - prefix[:-k]) * _hash.inverse[: n - k + 1])
    least = sliding_min((h & ~_LOW) | np.arange(len(h), dtype=U64), length - k + 1)
    change = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(off) >= length)
    np.add.at(change, off[long], 1)
    np.add.at(change, off[long + 1] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(change[: len(least)]) > 0)
    at = (least[start] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    end = np.r_[new[1:], len(at)] - 1
    place = at[new]
    rows = np.searchsorted(off, place, side="right") - 1
    return [rows + row, place - off[rows] + shift, place - start[end], place - start[new], h[place]]


class Surroundings:
    """Strings around anchors. right: suffixes from the anchor on; left: what stands before it, read backwards."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray):
        self.data, self.prefix = data, _hash.prefix(data)
        self.anchor, self.right, self.left = start + before, size - before, before

    def _same(self, x, y, n, forward):
        a, b = self.anchor[x], self.anchor[y]
        if forward:
            return _hash.span(self.prefix, a, a + n) == _hash.span(self.prefix, b, b + n)
        return _hash.span(self.prefix, a - n, a) == _hash.span(self.prefix, b - n, b)

    def common(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """The common extension of suffixes x and y, by binary search over hashes."""
        size = self.right if forward else self.left
        low, high = np.zeros(len(x), np.int64), np.minimum(size[x], size[y])
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self._same(x, y, mid, forward)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def below(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """-1, 0 or 1 as suffix x sorts before, with or after y; a proper beginning sorts first."""
        size, n = (self.right if forward else self.left), self.common(x, y, forward)
        a = np.where(n < size[x], self.data[np.minimum(self.anchor[x] + n, len(self.data) - 1) if forward else np.maximum(self.anchor[x] - n - 1, 0)].astype(np.int64), -1)
        b = np.where(n < size[y], self.data[np.minimum(self.anchor[y] + n, len(self.data) - 1) if forward else np.maximum(self.anchor[y] - n - 1, 0)].astype(np.int64), -1)
        return np.sign(a - b)

    def sort(self, group: np.ndarray, forward: bool) -> np.ndarray:
        """The order of all suffixes within their groups (equal neighbours in `group`), by mergesort of all groups at once."""
        n = len(group)
        order = np.arange(n)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, n])
        first, size = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while True:
            at = np.flatnonzero(size > width)
            if not len(at):
                return order
            place = at - first[at]
            pair = first[at] + place // (2 * width) * (2 * width)
            ours = place // width % 2  # 0: in the left run
            top = first[at] + size[at]
            left_end, right_end = np.minimum(pair + width, top), np.minimum(pair + 2 * width, top)
            low = np.where(ours == 0, left_end, pair)
            high = np.where(ours == 0, right_end, left_end)
            base = low.copy()
            for _ in range(int((high - low).max(initial=0)).bit_length()):
                open_ = np.flatnonzero(low < high)
                mid = (low[open_] + high[open_]) >> 1
                c = self.below(order[mid], order[at[open_]], forward)
                before = np.where(ours[open_] == 0, c < 0, c <= 0)  # ties: the left run first
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            goal = pair + (at - np.where(ours == 0, pair, left_end)) + (low - base)
            new = order.copy()
            new[goal] = order[at]
            order, width = new, width * 2

    def extensions(self, order: np.ndarray, group: np.ndarray, forward: bool) -> np.ndarray | None:
        """The common extension of each suffix with the one before it in the order; 0 across groups.

        Verified on the bytes: neighbours agree in all of it, and what follows puts them in this order. None if that fails.
        """
        x, y = order[:-1], order[1:]
        inside = group[x] == group[y]
        n = np.where(inside, self.common(x, y, forward), 0)
        a, b = (self.anchor[x], self.anchor[y]) if forward else (self.anchor[x] - n, self.anchor[y] - n)
        if not same_spans(self.data, a, self.data, b, n).all():
            return None
        size, last = (self.right if forward else self.left), len(self.data) - 1
        p, q = (self.anchor[x] + n, self.anchor[y] + n) if forward else (self.anchor[x] - n - 1, self.anchor[y] - n - 1)
        p = np.where(n < size[x], self.data[np.clip(p, 0, last)].astype(np.int64), -1)
        q = np.where(n < size[y], self.data[np.clip(q, 0, last)].astype(np.int64), -1)
        return np.r_[0, n] if ((p < q) | ~inside | ((p == q) & (p == -1))).all() else None

    def sorted(self, group: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """The order of all suffixes within their groups, and their extensions, both true of the bytes."""
        order = self.sort(group, forward)
        if (n := self.extensions(order, group, forward)) is not None:
            return order, n
        ends = (self.anchor + self.right if forward else self.anchor - self.left).tolist()
        keys = [self.data[a:e].tobytes() if forward else self.data[e:a][::-1].tobytes() for a, e in zip(self.anchor.tolist(), ends, strict=True)]
        order = np.array(sorted(range(len(keys)), key=lambda i: (group[i], keys[i])), np.int64)
        n = [0]
        for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            x, y = (np.frombuffer(keys[k][: min(len(keys[i]), len(keys[j]))], np.uint8) for k in (i, j))
            differ = np.flatnonzero(x != y)
            n.append(0 if group[i] != group[j] else int(differ[0]) if len(differ) else len(x))
        return order, np.array(n)


def repeated_strings(group, ids, place, least, most, data, start, size, length):
    """Which strings around anchors stand elsewhere at a smaller (id, place).

    Rows are anchors: group (hash), place in text id, offsets least to most, and where their surroundings lie in data. Returns runs
    (row, from, to): the strings from..to (offsets, both included) repeat an earlier one.
    """
    by = np.lexsort((place, ids, group))
    group, ids, place, least, most, start, size = (c[by] for c in (group, ids, place, least, most, start, size))
    # Equal surroundings: only the first is sorted; all strings of the others repeat its strings.
    prefix = _hash.prefix(data)
    code = mix64(_hash.span(prefix, start, start + size) + (least + (most << 16)).astype(U64)) ^ group
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    head = order[np.flatnonzero(np.r_[True, ~same])][np.cumsum(np.r_[True, ~same]) - 1] if len(order) else order
    first = np.empty(len(by), np.int64)
    first[order] = head
    copy = np.flatnonzero(first != np.arange(len(by)))
    like = np.logical_and.reduce([c[copy] == c[first[copy]] for c in (group, least, most, size)])
    like[like] = same_spans(data, start[copy[like]], data, start[first[copy[like]]], size[copy[like]])
    first[copy[~like]] = copy[~like]  # two different strings under one hash: each is sorted
    copy = copy[like]
    kept = np.flatnonzero(first == np.arange(len(by)))
    g, lo, hi = group[kept], least[kept], most[kept]
    s = Surroundings(data, start[kept], size[kept], hi)
    (forward, right), (backward, left) = s.sorted(g, True), s.sorted(g, False)
    span = int(hi.max(initial=0)) + 1
    dup = np.zeros((len(kept), span + 2), bool)
    classes = np.empty((2, len(kept)), np.int64)
    for o in range(int(lo.min(initial=0)), span):
        who = np.flatnonzero((lo <= o) & (o <= hi))
        if len(who) < 2:
            continue
        classes[0][forward] = np.cumsum(right < length - o)
        classes[1][backward] = np.cumsum(left < o) if o else np.cumsum(np.r_[True, g[backward][1:] != g[backward][:-1]])
        key = classes[0][who] << 32 | classes[1][who]
        by_key = np.argsort(key, kind="stable")  # rows are in the order of (id, place)
        again = np.r_[False, key[by_key][1:] == key[by_key][:-1]]
        dup[who[by_key[again]], o + 1] = True
    edges = dup[:, 1:] != dup[:, :-1]
    row, at = np.nonzero(edges)
    row, frm, to = row[::2], at[::2], at[1::2] - 1
    rows = np.r_[by[kept[row]], by[copy]]
    return rows, np.r_[frm, least[copy]], np.r_[to, most[copy]]


def _stretches(key: np.ndarray):
    """Ranges [a, b) of equal neighbours."""
    if len(key):
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _blocks(key: np.ndarray, *columns: np.ndarray):
    """(key, packed rows) for each distinct key."""
    by = np.argsort(key, kind="stable")
    key, columns = key[by], [c[by] for c in columns]
    for a, b in _stretches(key):
        yield int(key[a]), pack(*[c[a:b] for c in columns])


def _rows(found, schema=("cell", "kind", "block")):
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())], names=list(schema))


def small(batches, rows: int = 2048):
    """The same rows in batches of at most so many."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


ROW = "cell bigint, kind int, block binary"
COPY, REFS, TEXT = 0, 1, 2
AROUND, STRINGS, DONE = 0, 1, 2
FOUND = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, k: int = 30, hot: int = 1000, with_text: bool = True, carry: tuple[str, ...] = (), cell_bytes: int = 16 << 20) -> DataFrame:
    """One row for each row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, and the columns in `carry`.

    Removed is each UTF-8 byte covered by a string of `length` bytes that also starts earlier, in a smaller id or before in the same
    text; strings never cross texts. Spans are maximal removed runs. `kept_text` is the text without them, where a character goes only
    if all its bytes do; `with_text=False` leaves it null.

    Null and empty texts, and texts shorter than `length`, lose nothing; a null text counts as empty and its kept text is null. Of equal
    texts the smallest id loses only what the rest of the table makes it lose, the others everything. Rows without id are compared
    with nothing. Rows with equal ids and equal texts count as one. Different texts of one id are compared like those of different ids,
    in the order of their SHA-256. An empty table gives an empty result. Ids are bigints. A text is held whole by the task that cuts it.
    A task holds a cell of about `cell_bytes` of texts, however large the table.
    """
    extra = [c for c in carry if c not in (id_col, text_col)]
    out = _cut_repeats(docs, id_col, text_col, extra, length, k, hot, with_text, cell_bytes)
    return out.toDF(id_col, *FOUND, *extra)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of `docs` with the same columns, the text without its repeats: `kept_text` of remove_repeats()."""
    extra = [c for c in docs.columns if c not in (id_col, text_col)]
    at = {id_col: "_id", text_col: "kept_text"} | {c: f"_{i}" for i, c in enumerate(extra)}
    settings = {"length": 100, "k": 30, "hot": 1000, "cell_bytes": 16 << 20} | settings
    out = _cut_repeats(docs, id_col, text_col, extra, with_text=True, **settings).select(*[at[c] for c in docs.columns])
    return out.toDF(*docs.columns)


def _even_cells(spark, n: int) -> np.ndarray:
    """n values of a bigint column that a repartition by it into n partitions deals one to each."""
    tried = spark.range(n * (8 + 2 * n.bit_length())).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    found = {r["p"]: r["id"] for r in tried.collect()}  # one row for each partition
    return np.array([found.get(p, -1 - p) for p in range(n)], np.int64)


def _cut_repeats(docs, id_col, text_col, extra, length, k, hot, with_text, cell_bytes) -> DataFrame:
    """remove_repeats() with inner names: _id, those of FOUND, and the extra columns by place, _0 and so on."""
    spark = docs.sparkSession
    work = Workspace(spark, "suffixes")
    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(extra)])
    kinds_of_extra = [src.schema[f"_{i}"].dataType for i in range(len(extra))]
    own = once = src.where("_id is not null")
    text_sum = F.unhex(F.sha2(F.coalesce("_text", F.lit("")), 256))
    sums = work.save(own.select("_id", text_sum.alias("_sum"), F.octet_length("_text").alias("size")), "sums")
    size = sums.agg(F.sum("size")).first()[0] or 0
    cells = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (cell_bytes >> 6))), -(-size // cell_bytes))
    name_of = _even_cells(spark, cells)
    given = F.col("_id")
    if not sums.groupBy("_id").count().where("count > 1").isEmpty():
        # Ids repeat: below, the place of (id, text) in their order stands for the id, which goes along as a column, and rows that
        # are equal in both are compared once.
        numbers = work.save(with_positions(sums.select("_id", "_sum").distinct(), "_id", ("_sum",), "_nr"), "numbers")
        src = src.withColumn("_sum", text_sum).join(numbers, ["_id", "_sum"], "left")
        src = work.save(src.select(F.col("_nr").alias("_id"), "_text", *[f"_{i}" for i in range(len(extra))], F.col("_id").alias(f"_{len(extra)}")), "numbered")
        own = src.where("_id is not null")
        once = work.save(own.select("_id", "_text").dropDuplicates(["_id"]), "once")
        sums = sums.join(numbers, ["_id", "_sum"]).select(F.col("_nr").alias("_id"), "_sum", "size")
        given, kinds_of_extra = F.col(f"_{len(extra)}"), [*kinds_of_extra, LongType()]

    def _home(ids: np.ndarray) -> np.ndarray:
        """The cell that a text's blocks go to."""
        return name_of[(mix64(ids.view(U64) + U64(99)) % U64(cells)).astype(np.int64)]

    def cell_of(h: np.ndarray) -> np.ndarray:
        """The cell that a hash's blocks go to."""
        return name_of[(h % U64(cells)).astype(np.int64)]

    def intervals_of(ids, frm, to):
        """Blocks of intervals by the home of their text."""
        ids, frm, to = _joined(ids, frm, to)
        return _blocks(_home(ids), ids, frm.astype(np.uint32), to.astype(np.uint32))

    def dealt(df: DataFrame, *order: str) -> DataFrame:
        return df.repartition(cells, "cell").sortWithinPartitions("cell", *order)

    @lean
    def find(batches):
        for b in small(batches):
            data, off = utf8_view(b.column(1))
            row, place, least, most, h = anchors(data, off, length, k)
            ids = b.column(0).to_numpy()
            yield from _rows([(c, 0, x) for c, x in _blocks(cell_of(h), h, ids[row], place.astype(np.uint32), least.astype(np.uint16), most.astype(np.uint16))])

    @lean
    def shared(batches):
        for t in by_cell(batches):
            h, ids, place, least, most = unpack_all(t.column("block").to_pylist())
            by = np.argsort(h, kind="stable")
            new = np.r_[True, h[by][1:] != h[by][:-1]]
            count = np.diff(np.r_[np.flatnonzero(new), len(h)])[np.cumsum(new) - 1]
            by, count = by[count > 1], count[count > 1]
            yield from _rows([(c, REFS, x) for c, x in _blocks(_home(ids[by]), ids[by], place[by], least[by], most[by], h[by], count > hot)])

    refs = dealt(once.select("_id", "_text").mapInArrow(find, ROW)).mapInArrow(shared, ROW)
    # Of equal texts, all but the smallest id: they need no comparison.
    sums = sums.where(F.col("size") >= length).select("_id", F.col("_sum").alias("sum"))
    firsts = sums.groupBy("sum").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first <> last").select("sum", "first")
    firsts = work.save(firsts, "firsts", thin=True)  # so that the join has shuffles of its own, whose hot keys Spark can split
    copies = work.save(sums.join(firsts, "sum").where("_id <> first").select("_id"), "copies", thin=True)

    @lean
    def as_copies(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            yield from _rows([(c, COPY, x) for c, x in _blocks(_home(ids), ids)])

    def ship():
        @lean
        def run(batches):
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            for b in small(batches):
                home, found = _home(b.column(0).to_numpy()), []
                by = np.argsort(home, kind="stable")
                b, home = b.take(pa.array(by)), home[by]
                for i, j in _stretches(home):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema, options=options) as w:
                        w.write_batch(pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(i, j))) for c in b.columns], schema=b.schema))
                    found.append((int(home[i]), TEXT, sink.getvalue().to_pybytes()))
                yield from _rows(found)

        return run

    def by_home(*parts):
        union = parts[0]
        for p in parts[1:]:
            union = union.union(p)
        return dealt(union, "kind")

    texts = once.select("_id", "_text").where(F.octet_length("_text") >= length).mapInArrow(ship(), ROW)

    def texts_of(blocks):
        return pa.Table.from_batches([x for b in blocks for x in pa.ipc.open_stream(b)])

    def kinds(t):
        kind, blocks = t.column("kind").to_numpy(), t.column("block").to_pylist()
        return [[x for x, k_ in zip(blocks, kind, strict=True) if k_ == want] for want in (0, 1, 2)]

    @lean
    def around(batches):
        for t in by_cell(batches):
            gone, refs_, text_blocks = kinds(t)
            if not refs_ or not text_blocks:
                continue
            columns = unpack_all(refs_)
            if gone:
                keep = ~np.isin(columns[0], unpack_all(gone)[0])
                columns = [c[keep] for c in columns]
            by = np.argsort(columns[0], kind="stable")
            columns = [c[by] for c in columns]
            lone = []  # strings at busy anchors that no earlier block of this cell has shown to be equal
            for block in text_blocks:
                texts_ = texts_of([block])
                for i in range(0, texts_.num_rows, 256):
                    yield from surroundings(texts_.slice(i, 256), columns, lone)
            if lone:
                one, two, ids, at = (np.concatenate(c) for c in zip(*lone, strict=True))
                f, d = first_of(one, two, ids, at)
                found = [(c, STRINGS, x) for c, x in _blocks(cell_of(one[f]), one[f], two[f], ids[f], at[f].astype(np.uint32))]
                yield from _rows(found + [(c, DONE, x) for c, x in intervals_of(ids[d], at[d], at[d] + length)])

    def first_of(one, two, ids, at):
        """The rows with the smallest (id, place) of each digest, given as two numbers, and the others."""
        by = np.lexsort((at, ids, two, one))
        again = np.r_[False, (one[by][1:] == one[by][:-1]) & (two[by][1:] == two[by][:-1])] if len(by) else np.zeros(0, bool)
        return by[~again], by[again]

    def surroundings(t, columns, lone):
        own_ids, pick = np.unique(t.column(0).to_numpy(), return_index=True)
        a, b = np.searchsorted(columns[0], own_ids), np.searchsorted(columns[0], own_ids, side="right")
        w = np.arange((b - a).sum()) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
        if not len(w):
            return
        ids, place, least, most, h, busy = (c[w] for c in columns)
        place, least, most = place.astype(np.int64), least.astype(np.int64), most.astype(np.int64)
        data, off = utf8_view(t.column(1))
        start = off[pick[np.searchsorted(own_ids, ids)]] + place - most
        size = most - least + length
        found = []
        cold = np.flatnonzero(~busy)
        cell = cell_of(h)
        by = cold[np.argsort(cell[cold], kind="stable")]
        for i, j in _stretches(cell[by]):
            w = by[i:j]
            n = size[w]
            bytes_ = data[np.arange(n.sum()) + np.repeat(start[w] - (np.cumsum(n) - n), n)]
            found.append((int(cell[w[0]]), AROUND, pack(h[w], ids[w], place[w].astype(np.uint32), least[w].astype(np.uint16), most[w].astype(np.uint16), bytes_)))
        warm = np.flatnonzero(busy)
        if len(warm):
            n = (most - least + 1)[warm]
            who = np.repeat(warm, n)
            begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[who]
            at = begin - start[who] + place[who] - most[who]
            raw = data.tobytes()
            digests = b"".join(hashlib.blake2b(raw[x : x + length], digest_size=16).digest() for x in begin.tolist())
            one, two = np.frombuffer(digests, U64).reshape(-1, 2).T
            f, d = first_of(one, two, ids[who], at)
            lone.append((one[f], two[f], ids[who[f]], at[f]))
            found += [(c, DONE, x) for c, x in intervals_of(ids[who[d]], at[d], at[d] + length)]
        yield from _rows(found)

    @lean
    def settle(batches):
        for t in by_cell(batches):
            near, strings, done = kinds(t)
            found = [(int(_home(unpack(x)[0][:1])[0]), REFS, x) for x in done]
            if near:
                parts = [unpack(x) for x in near]
                group, ids, place, least, most, data = (np.concatenate(c) for c in zip(*parts, strict=True))
                del parts
                place, least, most = (c.astype(np.int64) for c in (place, least, most))
                size = most - least + length
                start = np.cumsum(size) - size
                order = np.argsort(group, kind="stable")
                ends = np.flatnonzero(np.r_[group[order][1:] != group[order][:-1], True]) + 1
                filled, a = np.cumsum(size[order]), 0
                while a < len(order):  # whole groups, a few megabytes at a time
                    k_ = np.searchsorted(filled[ends - 1], (filled[a - 1] if a else 0) + (1 << 20), side="right")
                    b = int(ends[min(max(k_, np.searchsorted(ends, a, side="right") + 1) - 1, len(ends) - 1)])
                    w = order[a:b]
                    n = size[w]
                    bytes_ = data[np.arange(n.sum()) + np.repeat(start[w] - (np.cumsum(n) - n), n)]
                    row, frm, to = repeated_strings(group[w], ids[w], place[w], least[w], most[w], bytes_, np.cumsum(n) - n, n, length)
                    row = w[row]
                    found += [(c, REFS, x) for c, x in intervals_of(ids[row], place[row] - to, place[row] - frm + length)]
                    a = b
            if strings:
                one, two, ids, at = unpack_all(strings)
                at = at.astype(np.int64)
                _, d = first_of(one, two, ids, at)
                found += [(c, REFS, x) for c, x in intervals_of(ids[d], at[d], at[d] + length)]
            yield from _rows(found)

    gone = copies.mapInArrow(as_copies, ROW)
    # A block of finished intervals needs no meeting: it may go through any cell.
    met = mapped(dealt(by_home(gone, refs, texts).mapInArrow(around, ROW)), settle, ROW)
    intervals = work.save(met, "intervals")
    whole = own.mapInArrow(ship(), ROW)

    @lean
    def cut(batches):
        for t in by_cell(batches):
            gone_, blocks, text_blocks = kinds(t)
            dropped = set(unpack_all(gone_)[0].tolist()) if gone_ else set()
            ids, frm, to = unpack_all(blocks) if blocks else (np.zeros(0, np.int64),) * 3
            by = np.lexsort((frm, ids))
            ids, frm, to = ids[by], frm[by].astype(np.int64), to[by].astype(np.int64)
            for block in text_blocks:
                yield from results(texts_of([block]), dropped, ids, frm, to)

    def results(t, dropped, ids, frm, to):
        data, off = utf8_view(t.column(1))
        null = t.column(1).is_null().to_pylist()
        own_ids = t.column(0).to_pylist()
        a, b = np.searchsorted(ids, own_ids), np.searchsorted(ids, own_ids, side="right")
        out = []
        for r, doc in enumerate(own_ids):
            text = data[off[r] : off[r + 1]]
            if doc in dropped and len(text) >= length:
                runs = [(0, len(text))]
            else:
                runs = merge(frm[a[r] : b[r]], to[a[r] : b[r]])
            out.append((len(text), sum(y - x for x, y in runs), len(runs), hashlib.sha256(without(text, runs)).hexdigest(), without(text, whole_characters(text, runs)).decode("utf-8", "replace") if with_text and not null[r] else None))
        kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in pa.Table.from_arrays([t.column(0), *[pa.array([x[i] for x in out], kinds_[i]) for i in range(5)], *[t.column(2 + i) for i in range(len(kinds_of_extra))]], names=names).combine_chunks().to_batches():
            yield batch

    names = ["_id", *FOUND, *[f"_{i}" for i in range(len(kinds_of_extra))]]
    schema = StructType.fromDDL("_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    schema = StructType([*schema.fields, *[StructField(f"_{i}", kind) for i, kind in enumerate(kinds_of_extra)]])
    out = by_home(gone, intervals, whole).mapInArrow(cut, schema)
    lone = src.where("_id is null").withColumn("_t", F.coalesce("_text", F.lit(""))).select("_id", F.octet_length("_t").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2("_t", 256).alias("kept_sha256"), F.col("_text").alias("kept_text") if with_text else F.lit(None).cast("string").alias("kept_text"), *[f"_{i}" for i in range(len(kinds_of_extra))])
    return out.union(lone).select(given.alias("_id"), *FOUND, *[f"_{i}" for i in range(len(extra))])


def merge(frm, to) -> list[tuple[int, int]]:
    """Maximal runs of intervals in the order of their starts."""
    if not len(frm):
        return []
    reach = np.maximum.accumulate(to)
    new = np.flatnonzero(np.r_[True, frm[1:] > reach[:-1]])
    return list(zip(frm[new].tolist(), reach[np.r_[new[1:] - 1, len(to) - 1]].tolist(), strict=True))


def without(text: np.ndarray, runs) -> bytes:
    raw, at, out = text.tobytes(), 0, []
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def whole_characters(text: np.ndarray, runs):
    """The runs without the bytes of characters that they hold only in part."""
    for a, b in runs:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            yield a, b


def _joined(ids, frm, to):
    """Intervals by id, where neighbours that touch are one."""
    by = np.lexsort((frm, ids))
    ids, frm, to = ids[by], frm[by], to[by]
    if len(ids):
        # Starts rise within an id, so an interval joins the one before if it starts at or before that one's end.
        new = np.r_[True, (ids[1:] != ids[:-1]) | (frm[1:] > to[:-1])]
        first = np.flatnonzero(new)
        ids, frm, to = ids[first], frm[first], np.maximum.reduceat(to, first)
    return ids, frm, to
