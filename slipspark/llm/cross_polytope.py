"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns a unit vector by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and names the signed
axis that it is nearest to. A table's bucket is what one or more such hashes say; the last one may look at the first few axes
only, so that the number of buckets fits the number of rows. A query probes, over all tables together, the buckets that its
own rotated coordinates make likeliest, and what lies there is ranked.

The index is a written table: a row per vector and table with its bucket and the vector in one byte per component, beside a bound
of what the rounding changed. Index rows and probes meet by bucket; each task ranks on intervals that hold the true distance and
drops only what surely isn't among a query's nearest candidates. What is left is ranked on the original vectors in double
precision. No candidate is capped. Buckets of many rows are dealt out in blocks, and probes go to each of them.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without
an id; vectors are compared with those of the same length only. Of a query id with several rows the least vector asks; an id with
several rows is found once, at its nearest. Ties go to the smaller id; a query with fewer candidates gets what it finds; empty
tables give an empty result; further columns are not read. Hashes see directions only: where lengths differ much, the nearest
by distance can lie in another direction, so recall has to be measured there.

Recall depends on ``tables`` and ``share`` (of the rows that a query meets, repeats over tables included). The default share falls with
the fourth root of the rows, which holds recall above 0.9 even on vectors drawn at random, the hardest case; where neighbours are
closer, much less will do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipspark.llm.common import partitions, small_batches, written

#: Rows of a bucket aimed at; rows of one block of a bucket; pairs that a task holds before it ranks them.
BUCKET_ROWS, BLOCK_ROWS, HELD_PAIRS = 40, 2000, 400_000
TABLES = 8
_ROUNDS, _SEED = 3, 20_240_607


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and the vector in doubles, of the rows that take part."""
    c = F.col(vector).cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0)
    )


@dataclass(frozen=True)
class Shape:
    """How vectors of one length are hashed: axes seen by each hash of a table, and probes of a query over all tables."""

    size: int
    axes: tuple[int, ...]
    probes: int

    @property
    def buckets(self) -> int:
        return int(np.prod([2 * a for a in self.axes], dtype=np.int64))


def default_share(n: int) -> float:
    return min(1.0, 4.2 * n**-0.25)


def shape(length: int, n: int, share: float, tables: int) -> Shape:
    size = 1 << (length - 1).bit_length()
    left, axes = n // BUCKET_ROWS // (2 * size), [size]
    while left >= 2 * size:
        axes.append(size)
        left //= 2 * size
    if left >= 2:
        axes.append(1 << (left // 2).bit_length() - 1)
    made = Shape(size, tuple(axes), 0)
    return Shape(size, tuple(axes), min(tables * made.buckets, int(np.ceil(share * made.buckets))))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; their length is a power of two."""
    n, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, size) / np.sqrt(size)


def rotated(unit: np.ndarray, table: int, nth: int, axes: int) -> np.ndarray:
    signs = np.random.default_rng([_SEED, table, nth]).choice([-1.0, 1.0], (_ROUNDS, unit.shape[1]))
    for s in signs:
        unit = hadamard(unit * s)
    return unit[:, :axes]


def directions(vectors: np.ndarray, size: int) -> np.ndarray:
    """Unit vectors, filled up with zeros."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    return np.pad(unit, ((0, 0), (0, size - unit.shape[1])))


def buckets(unit: np.ndarray, how: Shape, table: int) -> np.ndarray:
    key = np.zeros(len(unit), np.int64)
    for nth, axes in enumerate(how.axes):
        y = rotated(unit, table, nth, axes)
        at = np.abs(y).argmax(axis=1)
        key = key * (2 * axes) + 2 * at + (y[np.arange(len(y)), at] < 0)
    return key


def probed(unit: np.ndarray, how: Shape, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (table and bucket) that a query probes, and which query it is.

    A bucket costs the squared distances by which its axes stay behind the query's best ones. The cheapest of a table are
    grown hash by hash: what isn't among the cheapest beginnings can't be among the cheapest buckets."""
    n = len(unit)
    costs, keys = [], []
    for table in range(tables):
        cost, key = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for nth, axes in enumerate(how.axes):
            y = rotated(unit, table, nth, axes)
            behind = np.stack([y, -y], axis=2).reshape(n, -1)
            behind = (behind.max(axis=1, keepdims=True) - behind) ** 2
            cost = (cost[:, :, None] + behind[:, None, :]).reshape(n, -1)
            key = (key[:, :, None] * (2 * axes) + np.arange(2 * axes)).reshape(n, -1)
            if cost.shape[1] > how.probes:
                best = np.argpartition(cost, how.probes - 1, axis=1)[:, : how.probes]
                cost, key = np.take_along_axis(cost, best, 1), np.take_along_axis(key, best, 1)
        costs.append(cost)
        keys.append(key + table * how.buckets)
    cost, key = np.concatenate(costs, axis=1), np.concatenate(keys, axis=1)
    best = np.argsort(cost, axis=1, kind="stable")[:, : how.probes]
    return np.take_along_axis(key, best, 1).ravel(), np.repeat(np.arange(n), best.shape[1])


_STREAM = "length int, key long, probe int, id long, vector binary, scale double, slack double"


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, ids and vectors of the rows of each length in the batch."""
    ids, lists = batch["vec_id"].to_numpy(), batch["vector"]
    sizes = lists.value_lengths().to_numpy()
    for length in np.unique(sizes):
        which = np.flatnonzero(sizes == length)
        yield int(length), ids[which], lists.take(pa.array(which)).flatten().to_numpy().reshape(len(which), length)


def _binary(matrix: np.ndarray) -> pa.BinaryArray:
    width = matrix.shape[1] * matrix.itemsize
    at = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(matrix))])


def _rows(length: int, keys: np.ndarray, probe: int, ids: np.ndarray, vectors: np.ndarray, scale: np.ndarray, slack: np.ndarray) -> pa.RecordBatch:
    n = len(keys)
    columns = [pa.repeat(pa.scalar(length, pa.int32()), n), pa.array(keys), pa.repeat(pa.scalar(probe, pa.int32()), n), pa.array(ids)]
    names = ["length", "key", "probe", "id", "vector", "scale", "slack"]
    return pa.RecordBatch.from_arrays([*columns, _binary(vectors), pa.array(scale), pa.array(slack)], names)


@dataclass(frozen=True)
class Index:
    frame: DataFrame
    shapes: dict[int, Shape]
    tables: int


def build(rows: DataFrame, tables: int = TABLES, share: float | None = None) -> Index:
    """The index of all ``usable`` rows; one shape per length of vectors is what the driver learns of them."""
    small_batches(rows.sparkSession)
    lengths = {r["length"]: r["n"] for r in rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).collect()}
    shapes = {length: shape(length, n, default_share(n) if share is None else share, tables) for length, n in lengths.items()}

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, ids, vectors in _by_length(batch):
                how = shapes[length]
                scale = np.maximum(np.abs(vectors).max(axis=1) / 127, np.finfo(float).tiny)
                codes = np.rint(vectors / scale[:, None])
                slack = np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(axis=1))
                unit = directions(vectors, how.size)
                for table in range(tables):
                    yield _rows(length, buckets(unit, how, table) + table * how.buckets, 0, ids, codes.astype(np.int8), scale, slack)

    return Index(written(rows.mapInArrow(entries, _STREAM), "cross-polytope-index"), shapes, tables)


class _Pairs:
    """Pairs of query and row with bounds of their distance; keeps what may be among the ``k`` nearest of those seen."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])

    def ranked(self) -> list[np.ndarray]:
        if not self.parts:
            return [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]
        q, i, lo, hi = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((hi, i, q))
        q, i, lo, hi = q[order], i[order], lo[order], hi[order]
        new = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]))
        q, i, lo, hi = q[new], i[new], lo[new], hi[new]
        order = np.lexsort((hi, q))
        q, i, lo, hi = q[order], i[order], lo[order], hi[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        sizes = np.diff(np.append(first, len(q)))
        kth = np.where(sizes >= self.k, hi[np.minimum(first + self.k - 1, len(q) - 1)], np.inf)
        keep = lo <= np.repeat(kth, sizes)
        return [q[keep], i[keep], lo[keep], hi[keep]]

    def flushed(self, end: bool) -> Iterator[pa.RecordBatch]:
        if not end and self.n < HELD_PAIRS:
            return
        kept = self.ranked()
        self.parts, self.n = [kept], len(kept[0])
        if end or self.n > HELD_PAIRS // 2:
            for at in range(0, self.n, 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in kept], ["query_id", "vec_id", "lo", "hi"])
            self.parts, self.n = [], 0


def search(index: Index, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest candidates of each query.

    ``rows`` are the indexed ones, ``queries`` likewise ``usable``; a query's own id is no candidate."""
    spark = rows.sparkSession
    small_batches(spark)
    shapes, tables = index.shapes, index.tables
    asking = written(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), "cross-polytope-queries")

    def probes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, ids, vectors in _by_length(batch):
                if length not in shapes:
                    continue
                at_once = max(1, 1_000_000 // (shapes[length].probes * (2 * shapes[length].size + length)))
                for a in range(0, len(ids), at_once):
                    part = vectors[a : a + at_once]
                    keys, who = probed(directions(part, shapes[length].size), shapes[length], tables)
                    nothing = np.zeros(len(keys))
                    yield _rows(length, keys, 1, ids[a : a + at_once][who], part[who], nothing, nothing)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, group, ids, codes, bounds = _Pairs(k), None, [], [], []
        ready = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of = np.stack([batch[c].to_numpy() for c in ("length", "key", "block", "probe")], axis=1)
            new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]).any(axis=1)))
            at = np.frombuffer(batch["vector"].buffers()[1], np.int32)[batch["vector"].offset :]
            data = batch["vector"].buffers()[2]
            who, scale, slack = (batch[c].to_numpy() for c in ("id", "scale", "slack"))
            for a, b in zip(new, np.append(new[1:], n)):
                length, probe = int(of[a, 0]), of[a, 3]
                if (here := tuple(of[a, :3])) != group:
                    group, ids, codes, bounds, ready = here, [], [], [], None
                raw = np.frombuffer(data, np.float64 if probe else np.int8, (b - a) * length, at[a]).reshape(b - a, length)
                if not probe:
                    ids.append(who[a:b])
                    codes.append(raw)
                    bounds.append((scale[a:b], slack[a:b]))
                elif ids:
                    if ready is None:
                        s, e = (np.concatenate(c) for c in zip(*bounds))
                        held = np.concatenate(codes) * s[:, None]
                        ready = np.concatenate(ids), held, e, (held * held).sum(axis=1)
                    pairs.add(*_near(raw, who[a:b], *ready, k))
                    yield from pairs.flushed(False)
        yield from pairs.flushed(True)

    large = index.frame.groupBy("length", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS)
    large = large.select("length", "key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    entries = index.frame.join(large, ["length", "key"], "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    asked = asking.mapInArrow(probes, _STREAM).join(large, ["length", "key"], "left")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    stream = entries.drop("blocks").unionByName(asked.drop("blocks"))
    stream = stream.repartition(partitions(spark), "length", "key", "block").sortWithinPartitions("length", "key", "block", "probe")
    near = stream.mapInArrow(meet, "query_id long, vec_id long, lo double, hi double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    window = Window.partitionBy("query_id").orderBy("hi").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = near.withColumn("kth", F.nth_value("hi", k).over(window)).where(F.col("kth").isNull() | (F.col("lo") <= F.col("kth")))
    pairs = near.select("query_id", "vec_id").join(asking.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), "query_id")
    exact = pairs.join(rows, "vec_id").where(F.size("q") == F.size("vector"))
    squares = F.aggregate(F.zip_with("q", "vector", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    exact = exact.select("query_id", "vec_id", F.sqrt(squares).alias("score")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _near(q: np.ndarray, who: np.ndarray, ids: np.ndarray, held: np.ndarray, slack: np.ndarray, squares: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Pairs of the queries ``q`` and one block, with bounds of their distance; without what ``k`` others surely beat."""
    own = (q * q).sum(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.sqrt(np.maximum(own[:, None] + squares - 2 * (q @ held.T), 0))
        # the square root of a difference of nearly equal squares is off by this much at most
        rounding = 1e-7 * (np.sqrt(own)[:, None] + np.sqrt(squares)) + slack
        lo, hi = d - rounding, d + rounding
    odd = ~np.isfinite(d) | ~np.isfinite(rounding)
    lo[odd], hi[odd] = 0, np.inf
    same = who[:, None] == ids
    lo[same], hi[same] = np.inf, np.inf
    keep = ~same
    if len(ids) > k and len(np.unique(ids)) == len(ids):
        keep &= lo <= np.partition(hi, k - 1, axis=1)[:, k - 1 : k]
    a, b = np.nonzero(keep)
    return who[a], ids[b], lo[a, b], hi[a, b]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, share: float | None = None) -> DataFrame:
    """Index ``rows`` and search ``queries`` (both vec_id, embedding)."""
    fine = usable(rows)
    return search(build(fine, tables, share), fine, usable(queries), k)
