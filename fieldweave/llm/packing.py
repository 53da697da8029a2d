"""Best-fit packing of tokenized documents into fixed-length sequences, in bulk-synchronous supersteps.

A superstep takes the documents of one band of lengths, the longest band first, and the gaps of all open sequences that one of them
could fit:

1. Documents and gaps are range-sorted together by size, so that a document lies beside the gaps just as wide as it.
2. Each range is swept from its longest document down: the successor search finds the smallest gap that is wide enough, and a gap that
   took a document goes back with what is left of it.
3. What a range can't place goes to what wider ranges have left over. Ranges report two counts each; from these the driver deals
   places: the r-th document takes the r-th place, so that no two claim one.
4. Documents that fit nowhere open new sequences, gaps are updated, and the next band follows.

The number of supersteps depends on the capacity alone. Within one range the packing is that of sequential best-fit decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from fieldweave.llm.common import Workspace, lean, map_rows, need
from fieldweave.llm.tokens import token_ids, vocabulary_path

DOCUMENT, OPEN, GAP = 0, 1, 2  # kinds of rows: a placed document, one without a place, a gap
MOST_RANGES = 8192


def best_fit(lengths: np.ndarray, rooms: np.ndarray, capacity: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, the longest first, each into the smallest gap that is wide enough.

    Returns each document's gap, the room there before it, and the room left in each gap. Documents that fit nowhere open gaps of
    `capacity`, which are numbered on; without it their gap is -1. Documents of one length go together: as many side by side as a gap takes.
    """
    left = np.r_[rooms, np.full(len(lengths) if capacity else 0, capacity or 0)].astype(np.int64)
    at, before, used = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64), len(rooms)
    order: list[int] = []  # the rooms there are
    held: dict[int, list[np.ndarray]] = {}  # room -> gaps

    def add(room: int, gaps: np.ndarray) -> None:
        if room and len(gaps):
            if room not in held:
                held[room] = []
                insort(order, room)
            held[room].append(gaps)

    for room, gaps in _runs(rooms):
        add(room, gaps)
    for length, members in reversed(list(_runs(lengths))):
        i = 0
        while i < len(members):
            j = bisect_left(order, length)  # the successor
            if j < len(order):
                room = order[j]
                gaps = held[room].pop()
                if not held[room]:
                    del held[room]
                    order.pop(j)
            elif capacity:
                room, n = capacity, -(-(len(members) - i) // (capacity // length))
                gaps, used = np.arange(used, used + n), used + n
            else:
                break
            per = room // length
            n = min(len(members) - i, len(gaps) * per)
            nth = np.arange(n)
            at[members[i : i + n]] = gaps[nth // per]
            before[members[i : i + n]] = room - nth % per * length
            full, rest = divmod(n, per)
            for a, b, count in ((0, full, per), (full, full + (rest > 0), rest)):
                left[gaps[a:b]] = room - count * length
                add(room - count * length, gaps[a:b])
            add(room, gaps[full + (rest > 0) :])
            i += n
    return at, before, left[:used]


def _runs(sizes: np.ndarray):
    """(size, places of it), by size."""
    by = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.r_[True, sizes[by][1:] != sizes[by][:-1], True]) if len(by) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(sizes[by[a]]), by[a:b]


def deal_places(asked: dict[int, int], offered: dict[int, int]) -> np.ndarray:
    """Which places of wider ranges the documents of each range take: rows (range, first rank, wider range, first place, how many).

    Ranges are numbered by size. From the widest down, a range's documents take what the ranges above have left, the nearest first.
    """
    plan, free = [], []
    for p in sorted(asked.keys() | offered.keys(), reverse=True):
        rank, need_ = 0, asked.get(p, 0)
        while need_ and free:
            q, first, n = free.pop()
            take = min(need_, n)
            plan.append((p, rank, q, first, take))
            rank, need_ = rank + take, need_ - take
            if take < n:
                free.append((q, first + take, n - take))
        if offered.get(p):
            free.append((p, 0, offered[p]))
    return np.array(plan, np.int64).reshape(-1, 5)


def pieces_of(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row for each piece: _id, piece, start, length, ids_crc32, nr (a number of its own)."""
    src = need(docs, id_col, text_col)

    @lean
    def run(batches):
        nr = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for i, value in enumerate(b.column(1)):
                ids = np.append(token_ids(value.as_py() or "", path), np.uint32(end_id)).astype("<u4")
                n, start, piece = len(ids), 0, 0
                width = n % capacity or capacity
                while start < n:
                    rows.append((i, piece, start, width, zlib.crc32(ids[start : start + width].tobytes()), nr))
                    start, piece, width, nr = start + width, piece + 1, capacity, nr + 1
            t = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t[:, 0])), pa.array(t[:, 1].astype(np.int32)), *[pa.array(t[:, k]) for k in (2, 3, 4, 5)]], names=[f"_{k}" for k in range(6)])

    return map_rows(src, run, StructType([StructField("_id", src.schema[id_col].dataType), *PIECE]))


def _integers(small: tuple[str, ...], large: tuple[str, ...]) -> list[StructField]:
    return [*(StructField(c, IntegerType()) for c in small), *(StructField(c, LongType()) for c in large)]


PIECE = _integers(("piece",), ("start", "length", "ids_crc32", "nr"))
STATE = _integers(("kind", "range"), ("at", "places", "seq", "room"))


def _state(kind: int, part: int, at, places, seq, room, document: list[pa.Array]) -> pa.RecordBatch:
    n = len(room)
    number = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), n))
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), number(at), number(places), number(seq), number(room)]
    return pa.RecordBatch.from_arrays([*columns, *document], names=[f"_{k}" for k in range(12)])


def _documents(t: pa.Table, which: np.ndarray) -> list[pa.Array]:
    """The document's columns of some rows of a state table."""
    some = t.take(pa.array(which)).combine_chunks()
    return [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in some.columns[6:]]


def _superstep(work: Workspace, documents: DataFrame, gaps: DataFrame, band: int, ranges: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Places for all documents of a band, and the gaps afterwards."""
    kinds = documents.schema
    state = StructType([*STATE, *kinds.fields])
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields]
    zero = F.lit(0).cast("bigint")
    both = documents.select(F.lit(OPEN).alias("kind"), F.lit(0).alias("range"), zero.alias("at"), zero.alias("places"), zero.alias("seq"), F.col("length").alias("room"), *kinds.names)
    both = both.union(gaps.select(F.lit(GAP), F.lit(0), zero, zero, "seq", "room", *none))
    # Gaps sort after documents as wide as they are; the rest spreads one size over ranges.
    size = F.col("room") * 2 + (F.col("kind") == GAP).cast("int")
    sorted_ = both.repartitionByRange(ranges, size, F.xxhash64("seq", "nr")) if ranges > 1 else both.coalesce(1)

    @lean
    def sweep(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t, part = pa.Table.from_batches(held), TaskContext.get().partitionId()
        kind, seq, room = (t.column(k).to_numpy() for k in (0, 4, 5))
        d, g = np.flatnonzero(kind == OPEN), np.flatnonzero(kind == GAP)
        at, before, left = best_fit(room[d], room[g], capacity if ranges == 1 else None)  # one range has no wider ones to ask
        seq = np.r_[seq[g], (band << 57) + (part << 32) + np.arange(len(left) - len(g))]
        if len(hit := np.flatnonzero(at >= 0)):
            yield _state(DOCUMENT, part, 0, 0, seq[at[hit]], before[hit], _documents(t, d[hit]))
        if len(miss := np.flatnonzero(at < 0)):
            miss = miss[np.argsort(-room[d[miss]], kind="stable")]
            yield _state(OPEN, part, np.arange(len(miss)), 0, 0, room[d[miss]], _documents(t, d[miss]))
        if len(left):
            # No document of a narrower range is longer than this range's smallest row, so a gap has so many places for them.
            by = np.argsort(left, kind="stable")
            places = left[by] // room.min()
            yield _state(GAP, part, np.cumsum(places) - places, places, seq[by], left[by], [pa.nulls(len(left), c.type) for c in t.columns[6:]])

    swept = work.save(map_rows(sorted_, sweep, state), "swept")
    if ranges == 1:
        return swept.where(F.col("kind") == DOCUMENT).select(*kinds.names, "seq", "room"), swept.where(F.col("kind") == GAP).select("seq", "room")
    reports = swept.where(F.col("kind") != DOCUMENT).groupBy("kind", "range").agg(F.count("*").alias("n"), F.sum("places").alias("places")).collect()  # two rows for each range
    plan = deal_places({r["range"]: r["n"] for r in reports if r["kind"] == OPEN}, {r["range"]: r["places"] for r in reports if r["kind"] == GAP})
    waiting, after = swept.where(F.col("kind") == OPEN), swept.where(F.col("kind") == GAP)
    placed = swept.where(F.col("kind") == DOCUMENT).select(*kinds.names, "seq", "room")
    if len(plan):
        waiting, taken = _take_places(work, waiting, after, plan, kinds)
        placed = placed.union(taken.select(*kinds.names, "seq", "room"))
        after = after.join(taken.groupBy("seq").agg(F.sum("length").alias("used")), "seq", "left").withColumn("room", F.col("room") - F.coalesce("used", F.lit(0)))
    after = after.select("seq", "room")
    if any(r["kind"] == OPEN for r in reports):

        @lean
        def start(batches):
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            t, part = pa.Table.from_batches(held), TaskContext.get().partitionId()
            at, before, left = best_fit(t.column(5).to_numpy(), np.zeros(0, np.int64), capacity)
            number = (band << 57) + (part << 32)
            yield _state(DOCUMENT, part, 0, 0, number + at, before, _documents(t, np.arange(t.num_rows)))
            yield _state(GAP, part, 0, 0, number + np.arange(len(left)), left, [pa.nulls(len(left), c.type) for c in t.columns[6:]])

        started = work.save(map_rows(waiting.select(*state.names), start, state), "started")
        placed = placed.union(started.where(F.col("kind") == DOCUMENT).select(*kinds.names, "seq", "room"))
        after = after.union(started.where(F.col("kind") == GAP).select("seq", "room"))
    return placed, after


def _take_places(work: Workspace, waiting: DataFrame, gaps: DataFrame, plan: np.ndarray, kinds: StructType) -> tuple[DataFrame, DataFrame]:
    """Documents that still wait, and those that took the places dealt to them in wider ranges."""
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    key = plan[:, 0] << 40 | plan[:, 1]
    used = {int(q): int((plan[plan[:, 2] == q, 3] + plan[plan[:, 2] == q, 4]).max()) for q in np.unique(plan[:, 2])}

    @lean
    def aim(batches):
        for b in batches:
            part, rank = b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy()
            i = np.searchsorted(key, part << 40 | rank, side="right") - 1
            row = plan[np.maximum(i, 0)]
            ok = (i >= 0) & (row[:, 0] == part) & (rank < row[:, 1] + row[:, 4])
            place = np.where(ok, row[:, 3] + rank - row[:, 1], -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(ok, row[:, 2], -1).astype(np.int32)), pa.array(place), *b.columns[3:]], names=b.schema.names)

    aimed = work.save(map_rows(waiting, aim), "aimed")
    ends = waiting.sparkSession.createDataFrame(list(used.items()), "range int, ending bigint")  # a row for each range at most
    places = gaps.join(ends, "range").where("places > 0 and at < ending").select("range", F.explode(F.sequence("at", F.least(F.col("at") + F.col("places"), "ending") - 1)).alias("at"), F.col("seq").alias("gap"), F.col("room").alias("whole"))
    earlier = Window.partitionBy("gap").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    taken = aimed.where("at >= 0").join(places, ["range", "at"]).withColumn("room", F.col("whole") - F.coalesce(F.sum("length").over(earlier), F.lit(0))).select(*kinds.names, F.col("gap").alias("seq"), "room")
    return aimed.where("at < 0"), work.save(taken, "taken")


def bands_of(capacity: int, narrowest: int = 32) -> list[tuple[int, int]]:
    """Bands of lengths (over, up to), each half as wide as the one before, the longest first; the last holds all that is left."""
    out, top = [], capacity
    while top > max(1, capacity // narrowest):
        out.append((top // 2, top))
        top //= 2
    return [*out, (0, top)]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 2048, end_id: int = 0, range_rows: int = 100_000) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    A document is its token ids and then `end_id`; a null or empty text is `end_id` alone. Longer documents than `capacity`
    are cut into pieces of that length, of which the first may be shorter. Returns for each piece: id, piece (from 0),
    start, length, ids_crc32, sequence_id, offset. Equal lengths and repeated rows each get their own place; null ids are
    packed like others; an empty table gives an empty result. A text is tokenized whole. Ranges have about `range_rows` rows; as their
    reports meet on the driver, there are 8,192 at most, and with more than 800 million rows in a band ranges grow.
    """
    path = path or vocabulary_path()
    work = Workspace(docs.sparkSession, "pack")
    pieces = work.save(pieces_of(docs, id_col, text_col, path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    gaps = docs.sparkSession.createDataFrame([], "seq bigint, room bigint")
    out = None
    for band, (over, top) in enumerate(bands_of(capacity)):
        n = sum(c for length, c in histogram.items() if over < length <= top)
        if not n:
            continue
        wide = gaps.where(F.col("room") > over)
        ranges = min(MOST_RANGES, -(-(n + (wide.count() if out is not None else 0)) // range_rows))
        placed, after = _superstep(work, pieces.where((F.col("length") > over) & (F.col("length") <= top)), wide, band, ranges, capacity)
        before = gaps
        gaps = work.save(gaps.where(F.col("room") <= over).union(after.where("room > 0")), "gaps")
        work.drop(before)
        out = placed if out is None else out.union(placed)
    if out is None:
        out = pieces.select("*", F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("room"))
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), (capacity - F.col("room")).alias("offset"))
