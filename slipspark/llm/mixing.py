"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions; slot ranges are walked in Python.

Documents of a source are dealt into blocks. Block ``j`` of a source of weight ``w`` may be placed from slot floor(j / w) on
and has to be before ceil((j + 1) / w); at every slot the released block with the earliest deadline goes next. Then at any
slot every source has placed its share to within less than one block, as long as it has blocks left.

Every source is a stream of its own, and its weight is held in whole parts of 2^40, so that after 10 billion slots what was
asked for and what is placed differ by a hundredth of a block more.

Slots are cut into ranges of about equal numbers of blocks, which are walked in parallel. What one range hands to the next
is which released blocks still wait, at most one per source. A waiting block may take any slot of the next range, so of those
and of the blocks that a range places when nothing waits, the ones with the latest deadlines are put off: a first walk says
what each range does alone, the driver passes one bit per source from range to range, a second walk gives the slots. The
result is that of one walk over all slots, wherever they are cut. Slots in which nothing is ready are skipped.

Blocks come from ranks in hash order, counted in buckets of which every source has as many as its size asks for, so a source
that holds a third of all rows is ranked in many tasks. The driver and broadcasts hold one row per source and bucket.

Defined results: null is a source like any other, and so is the empty string. Rows of one id keep their places by text;
equal rows stand side by side, in any order. Where a source has run out, its slots stay empty and the rest goes on; no row
is dropped or repeated. An empty table gives an empty result. Columns of the input are not changed; clashing names do no harm.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slipspark.llm.common import partitions, written

#: Blocks of a range (about; more where there are many sources), which any choice leaves the result the same.
SLOTS, BLOCK_ROWS, ALPHA = 1 << 16, 32, 0.5
#: Parts in which weights are held.
BITS = 40
PARTS = 1 << BITS
#: What sources without a weight share if the others leave them less.
LEFT_OUT = 0.001


def parts_of(weights: list[float], slots: int) -> list[int]:
    """Whole parts of ``slots`` in proportion, one at least for each, by largest remainder."""
    total = sum(weights)
    exact = [w / total * slots for w in weights]
    parts = [max(1, int(e)) for e in exact]
    left = slots - sum(parts)
    if left >= 0:
        by_remainder = sorted(range(len(parts)), key=lambda i: (parts[i] - exact[i], i))
        for at in range(left):
            parts[by_remainder[at % len(parts)]] += 1
        return parts
    over = [(exact[i] - parts[i], -parts[i], i) for i in range(len(parts)) if parts[i] > 1]
    heapq.heapify(over)
    for _ in range(-left):
        _, _, i = heapq.heappop(over)
        parts[i] -= 1
        if parts[i] > 1:
            heapq.heappush(over, (exact[i] - parts[i], -parts[i], i))
    return parts


def walk(waiting: list[tuple[int, int, int]], released: list[tuple[int, int, int, int]], start: int, end: int):
    """Places of (deadline, stream, block) in slots from ``start`` to ``end``, and what is left: earliest deadline first among
    ``waiting`` and the blocks ``released`` by then, which are sorted (release, deadline, stream, block)."""
    ready, out, at, slot = list(waiting), [], 0, start
    heapq.heapify(ready)
    while slot < end and (ready or at < len(released)):
        if not ready:
            slot = max(slot, released[at][0])
        while at < len(released) and released[at][0] <= slot:
            heapq.heappush(ready, released[at][1:])
            at += 1
        out.append((slot, *heapq.heappop(ready)))
        slot += 1
    return out, ready + [r[1:] for r in released[at:]]


def period(parts: list[int]) -> list[tuple[int, int]]:
    """(stream, block) of each slot of one period of weights in whole parts of its length."""
    slots = sum(parts)
    released = sorted((j * slots // p, -(-(j + 1) * slots // p), s, j) for s, p in enumerate(parts) for j in range(p))
    return [(stream, block) for _, _, stream, block in walk([], released, 0, slots)[0]]


class Sources:
    """Weights in parts of PARTS, and the number of blocks, of every stream. All arithmetic is exact."""

    def __init__(self, parts: list[int], blocks: list[int]):
        self.parts, self.blocks = np.array(parts, np.int64), np.array(blocks, np.int64)

    def at(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks released before slot t; and, in parts of slots, how far behind t the next one's exact release is."""
        rest = ((self.parts.astype(np.uint64) * np.uint64(t)) & np.uint64(PARTS - 1)).astype(np.int64)
        if t < 1 << 43:
            whole = (self.parts * (t >> 20) + (self.parts * (t & 0xFFFFF) >> 20)) >> 20
        else:
            whole = (self.parts.astype(object) * t >> BITS).astype(np.int64)
        return whole + (rest > 0), np.where(rest > 0, PARTS - rest, 0)

    def deadlines(self, t: int) -> np.ndarray:
        """Of each stream's last block released before t."""
        return t + -(-self.at(t)[1] // self.parts)

    def released(self, start: int, end: int) -> list[tuple[int, int, int, int]]:
        """(release, deadline, stream, block) of the blocks released in these slots, sorted."""
        (first, behind), (last, _) = self.at(start), self.at(end)
        count = np.maximum(np.minimum(last, self.blocks) - first, 0)
        stream = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(stream)) - np.repeat(np.cumsum(count) - count, count)
        exact, parts = behind[stream] + nth * PARTS, self.parts[stream]
        rows = start + exact // parts, start + -(-(exact + PARTS) // parts), stream, first[stream] + nth
        order = np.lexsort((rows[2], rows[1], rows[0]))
        return list(zip(*(r[order].tolist() for r in rows)))

    def waiting(self, pending: np.ndarray, start: int) -> list[tuple[int, int, int]]:
        streams = np.flatnonzero(pending)
        return list(zip(self.deadlines(start)[streams].tolist(), streams.tolist(), (self.at(start)[0][streams] - 1).tolist()))

    def ranges(self, slots: int) -> list[tuple[int, int]]:
        """Slot ranges of about ``slots`` blocks each, up to behind the last block."""
        live = np.flatnonzero(self.blocks)
        if not len(live):
            return []
        last = max(-(-int(n) * PARTS // int(p)) for n, p in zip(self.blocks[live], self.parts[live]))
        if last * BLOCK_ROWS >= 1 << 62:
            raise ValueError("a weight is so small that its source's places don't fit a long")
        slots = max(slots, min(16 * len(self.parts), 1 << 20))
        ends = self.blocks[live] * float(PARTS) / self.parts[live]
        order = np.argsort(ends)
        rate = self.parts[live][order] / PARTS
        alive = rate[::-1].cumsum()[::-1]  # blocks per slot up to each end
        ends = np.concatenate([[0.0], ends[order]])
        done = np.concatenate([[0.0], np.cumsum(np.diff(ends) * alive)])
        cuts = np.interp(np.arange(slots, done[-1], slots), done, ends).astype(np.int64)
        bounds = [0, *sorted({int(c) for c in cuts if 0 < c < last}), last]
        return list(zip(bounds, bounds[1:]))

    def alone(self, start: int, end: int) -> tuple[int, np.ndarray, np.ndarray]:
        """What a range does if nothing waits: how many blocks it places; streams of which it places a block that could also
        go behind its end; streams of which a released block is left."""
        placed, left = walk([], self.released(start, end), start, end)
        movable, open_ = np.zeros(len(self.parts), bool), np.zeros(len(self.parts), bool)
        movable[[s for _, deadline, s, _ in placed if deadline > end]] = True
        open_[[s for _, s, _ in left]] = True
        return len(placed), movable, open_

    def hand_over(self, pending: np.ndarray, start: int, end: int, placed: int, movable: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Streams of which a released block waits at ``end``, from those at ``start`` and what the range does alone."""
        extra = placed + int(pending.sum()) - (end - start)
        after = open_.copy()
        if extra > 0:
            before, behind = np.flatnonzero(pending), np.flatnonzero(movable)
            stream = np.concatenate([before, behind])
            deadline = np.concatenate([self.deadlines(start)[before], self.deadlines(end)[behind]])
            after[stream[np.lexsort((stream, deadline))[-extra:]]] = True
        return after


def _alone(shared) -> Callable:
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in zip(batch.column("start").to_pylist(), batch.column("end").to_pylist()):
                placed, movable, open_ = shared.value[0].alone(start, end)
                yield pa.RecordBatch.from_pylist([{"start": start, "placed": placed, "movable": np.packbits(movable).tobytes(), "open": np.packbits(open_).tobytes()}])

    return alone


def _places(shared, block_rows: int) -> Callable:
    """(stream, bucket, block, slot) of every block, once for each bucket that holds rows of it."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, base, rows, firsts, bucket = shared.value
        for batch in batches:
            for start, end, bits in zip(*(batch.column(c).to_pylist() for c in ("start", "end", "pending"))):
                pending = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(base)).astype(bool)
                out, _ = walk(sources.waiting(pending, start), sources.released(start, end), start, end)
                slot, _, stream, block = np.array(out, np.int64).reshape(-1, 4).T
                low = base[stream] + block * block_rows
                high = np.minimum(low + block_rows, base[stream] + rows[stream]) - 1
                one, two = (np.searchsorted(firsts, x, "right") - 1 for x in (low, high))
                times = two - one + 1
                at = np.repeat(one, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                columns = np.repeat(stream, times), bucket[at], np.repeat(block, times), np.repeat(slot, times)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, ("i4", "i4", "i8", "i8"))], names=["stream", "bucket", "block", "slot"])

    return places


def schedule(docs: DataFrame, *, weights: dict | None = None, slots: int = SLOTS, block_rows: int = BLOCK_ROWS, alpha: float = ALPHA, text: str = "text") -> DataFrame:
    """(doc: all columns as one struct, stream, target, block, slot, position) for every row of ``docs``.

    ``weights`` gives sources their targets; those it leaves out share what is left to 1 by their numbers of rows. Without it
    a source's target is its number of rows to the power of ``alpha``. ``target`` is the weight as asked for, of a sum of 1.
    ``position`` orders the mixture. About ``slots`` blocks are walked as one range.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("source").cast("string").alias("named"), F.xxhash64("doc_id", text).alias("h"), F.col("doc_id").alias("id"))
    sizes = {r["named"]: r["n"] for r in rows.groupBy("named").agg(F.count("*").alias("n")).collect()}
    if weights is None:
        asked = {s: n**alpha for s, n in sizes.items()}
    else:
        others = {s: n for s, n in sizes.items() if s not in weights}
        left = max(1 - math.fsum(weights.values()), LEFT_OUT) / max(1, sum(others.values()))
        asked = weights | {s: n * left for s, n in others.items()}
    names = sorted(asked, key=lambda s: (s is not None, s or ""))
    total = math.fsum(asked.values())
    n_rows = np.array([sizes.get(s, 0) for s in names], np.int64)
    sources = Sources(parts_of([asked[s] for s in names], PARTS) if names else [], -(-n_rows // block_rows))

    everything = max(1, int(n_rows.sum()))
    streams = [(s, i, asked[s] / total, max(1, -(-4 * partitions(spark) * int(n_rows[i]) // everything))) for i, s in enumerate(names)]
    mapped = spark.createDataFrame(streams, "name string, stream int, target double, width int")
    rows = rows.join(F.broadcast(mapped), rows["named"].eqNullSafe(mapped["name"])).drop("named", "name")
    rows = rows.withColumn("bucket", F.pmod("h", "width").cast("int")).drop("width")
    counts = rows.groupBy("stream", "bucket").agg(F.count("*").alias("n")).orderBy("stream", "bucket").toArrow()  # 4 rows per partition and one per stream
    of, bucket, n = (counts.column(c).to_numpy() for c in ("stream", "bucket", "n"))
    firsts, base = np.cumsum(n) - n, np.cumsum(n_rows) - n_rows
    before = spark.createDataFrame(list(zip(of.tolist(), bucket.tolist(), (firsts - base[of]).tolist())), "stream int, bucket int, before long")
    ranked = rows.withColumn("nth", F.row_number().over(W.partitionBy("stream", "bucket").orderBy("h", "id"))).join(F.broadcast(before), ["stream", "bucket"])
    ranked = ranked.withColumn("rank", F.col("nth") - 1 + F.col("before")).withColumn("block", F.floor(F.col("rank") / block_rows))

    shared = sc.broadcast((sources, base, n_rows, firsts, bucket))
    ranges = sources.ranges(slots)
    pending, handed = np.zeros(len(names), bool), []
    done: dict = {}
    if len(ranges) > 1:
        found = spark.createDataFrame(ranges, "start long, end long").repartition(partitions(spark)).mapInArrow(_alone(shared), "start long, placed long, movable binary, open binary")
        done = {r["start"]: r for r in found.collect()}
    for start, end in ranges:
        handed.append((start, end, bytearray(np.packbits(pending).tobytes())))
        if r := done.get(start):
            movable, open_ = (np.unpackbits(np.frombuffer(r[c], np.uint8), count=len(names)).astype(bool) for c in ("movable", "open"))
            pending = sources.hand_over(pending, start, end, r["placed"], movable, open_)
    walked = spark.createDataFrame(handed, "start long, end long, pending binary").repartition(partitions(spark))
    places = written(walked.mapInArrow(_places(shared, block_rows), "stream int, bucket int, block long, slot long"), "mixing-places")
    # the blocks of a bucket follow one another; rows are dealt by bucket already, so they stay where they are
    lookup = places.groupBy("stream", "bucket").agg(F.array_sort(F.collect_list(F.struct("block", "slot"))).alias("places"))
    out = ranked.join(lookup, ["stream", "bucket"]).withColumn("slot", F.expr("places[cast(block - places[0].block as int)].slot"))
    return out.select("doc", "stream", "target", "block", "slot", (F.col("slot") * block_rows + F.col("rank") % block_rows).alias("position"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents in the order of the mixture, columns unchanged: files and rows follow one another by position."""
    placed = schedule(docs, **settings).select("doc", "position")
    ranged = placed.repartitionByRange(partitions(docs.sparkSession), "position").sortWithinPartitions("position")
    return ranged.select("doc.*")


def digest(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), "target", "block", "slot", "position")
