"""Hard-negative mining from shared, anchor-clustered candidate lists.

Anchors are clustered by direction. For a cluster whose members lie within an angle t of its centre, a candidate at the angle s
can't score above |candidate| |anchor| cos(max(0, s - t)) with any of them. So candidates are sorted by that bound once per cluster, and every
member walks the same list, from the top, until the bound of what follows certifies that nothing there can matter to it.

Lists are cut into slices and clusters into chunks of members, so that one task holds a few thousand rows whatever the size of a
cluster, and a slice is walked as the whole list would be. A candidate goes only to the lists of those clusters in which
its bound reaches what the least demanding member still needs. Positives come first, in two turns: candidates whose nearest centre
is the anchor's own give every anchor a score to beat, and then only those of other clusters that may beat it move. The
negatives of a positive lie in a known range of scores, which is certified in the same way.

Scores are exact integer inner products. Defined results: rows without id, label or vector, or with a null or non-finite component
take no part; nor do rows of which the squared length reaches 2^62, whose scores may not fit 64 bits. An id with several rows counts once,
with its least label, then vector. Vectors of different lengths never meet. Ties go to the smaller id. An anchor without
positives, or a positive without a negative in its range, gives no rows; so do empty tables. Further columns are not read.
The centres come from a bounded sample of anchors (``SAMPLE``); they decide what is walked, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipspark.llm.common import small_batches, written

#: Anchors that the centres are fitted on; a cluster for each so many anchors, between these bounds.
SAMPLE, ANCHORS_A_CLUSTER, CLUSTERS = 10_000, 256, (8, 1024)
#: Rows in a slice of a list, members in a chunk of a cluster, rows of a list looked at together.
SLICE_ROWS, CHUNK_MEMBERS, STEP_ROWS = 8192, 1024, 512
#: Bounds are raised by this share of the lengths against rounding.
_SLACK = 1e-6
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def prepared(rows: DataFrame, label: Column, anchor: Column) -> DataFrame:
    """vec_id, label, vector (whole numbers), anchor: the rows that take part, one per id.

    ``rows`` has vec_id and embedding; components become floor(256 x)."""
    numbers = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x))
    fine = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**40))
    taken = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & label.isNotNull())
    taken = taken.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), numbers.alias("vector"), anchor.alias("anchor"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    taken = taken.where(square < 2.0**62).groupBy("vec_id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row"))
    return taken.select("vec_id", "row.*")


def _packed(matrix: np.ndarray) -> pa.BinaryArray:
    """Each row as bytes, two per component where that is enough for all."""
    small = not matrix.size or np.abs(matrix).max() < 2**15
    matrix = np.ascontiguousarray(matrix, np.int16 if small else np.int64)
    at = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1] * matrix.itemsize
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(at), pa.py_buffer(matrix)])


def _unpacked(column: pa.ChunkedArray, length: int) -> np.ndarray:
    raw = column.to_pylist()
    return np.array([np.frombuffer(r, np.int16 if len(r) == 2 * length else np.int64) for r in raw], np.int64).reshape(len(raw), length)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, rows of the batch that have it, and their vectors."""
    lists = batch["vector"]
    sizes = lists.value_lengths().to_numpy()
    for length in np.unique(sizes):
        which = np.flatnonzero(sizes == length)
        yield int(length), which, lists.take(pa.array(which)).flatten().to_numpy().reshape(len(which), length)


def _directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero stays zero) and lengths."""
    v = vectors.astype(np.float64)
    norms = np.sqrt((v * v).sum(axis=1))
    return v / np.where(norms > 0, norms, 1)[:, None], norms


def _centres(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from members that lie far from each other, as far as random tries find."""
    rng = np.random.default_rng(7)
    unit, _ = _directions(vectors)
    centres = unit[[rng.integers(len(unit))]]
    nearest = unit @ centres[0]
    for _ in range(1, min(k, len(unit))):
        tries = rng.integers(len(unit), size=8)
        new = unit[tries[np.argmin(nearest[tries])]]
        centres = np.vstack([centres, new])
        nearest = np.maximum(nearest, unit @ new)
    for _ in range(8):
        at = (unit @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            mean = unit[at == c].sum(axis=0)
            if (size := np.sqrt(mean @ mean)) > 0:
                centres[c] = mean / size
    return centres


class Clusters:
    """Per length of vectors: centres, and of each cluster the widest angle, the least and greatest length of a member, members."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres, self.spread = centres, {}

    def angles(self, unit: np.ndarray, length: int) -> np.ndarray:
        return np.arccos(np.clip(unit @ self.centres[length].T, -1, 1))

    def bounds(self, unit: np.ndarray, norms: np.ndarray, length: int) -> np.ndarray:
        """What a candidate can score at most with a member of length one, for each cluster."""
        apart = np.maximum(self.angles(unit, length) - self.spread[length]["angle"], 0)
        return norms[:, None] * (np.cos(np.minimum(apart, np.pi)) + _SLACK)


def _fitted(anchors: DataFrame) -> tuple[Clusters, DataFrame]:
    """The clusters, and anchors with their length of vector and cluster as a written table."""
    spark = anchors.sparkSession
    counts = {r["length"]: r["n"] for r in anchors.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).collect()}
    centres = {}
    for length, n in counts.items():
        sample = anchors.where(F.size("vector") == length).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
        drawn = sample.select("vector").collect()
        vectors = np.array([r["vector"] for r in drawn], np.int64).reshape(len(drawn), length)
        centres[length] = _centres(vectors, min(CLUSTERS[1], max(CLUSTERS[0], n // ANCHORS_A_CLUSTER)))
    clusters = Clusters(centres)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, which, vectors in _by_length(batch):
                unit, norms = _directions(vectors)
                angles = clusters.angles(unit, length)
                at = angles.argmin(axis=1)
                n, rows = len(which), pa.array(which)
                columns = [pa.repeat(pa.scalar(length, pa.int32()), n), pa.array(at.astype(np.int32)), batch["vec_id"].take(rows), batch["label"].take(rows)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, _packed(vectors), pa.array(angles[np.arange(n), at]), pa.array(norms)],
                    ["length", "cluster", "anchor_id", "label", "vector", "angle", "norm"],
                )

    kind = "length int, cluster int, anchor_id long, label string, vector binary, angle double, norm double"
    members = written(anchors.mapInArrow(assign, kind), "hard-negatives-anchors")
    found = members.groupBy("length", "cluster").agg(F.max("angle").alias("angle"), F.min("norm").alias("least"), F.max("norm").alias("most"), F.count("*").alias("members"))
    for length, c in centres.items():
        clusters.spread[length] = {"angle": np.zeros(len(c)), "least": np.zeros(len(c)), "most": np.zeros(len(c)), "members": np.zeros(len(c), np.int64)}
    for r in found.collect():
        for name in ("angle", "least", "most", "members"):
            clusters.spread[r["length"]][name][r["cluster"]] = r[name]
    return clusters, members


def _walk(label: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, want: dict[str, np.ndarray], same: bool, k: int) -> tuple[np.ndarray, ...]:
    """Members walk one list. ``want`` has a row per wish: anchor, label, vector, ceiling, floor. Gives wish, id and score of
    the ``k`` best rows between floor and ceiling that have the wish's label, or haven't."""
    order = np.lexsort((ids, -bounds))
    label, ids, vectors, bounds = label[order], ids[order], vectors[order], bounds[order]
    n = len(want["anchor"])
    _, lengths = _directions(want["vector"])
    exact = np.float64 if lengths.max(initial=0) * np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0) < 2.0**52 else np.int64
    wishes, listed = want["vector"].astype(exact), vectors.astype(exact)
    best, who = np.full((n, k), _LEAST), np.full((n, k), _MOST)
    alive = np.arange(n)
    for at in range(0, len(ids), STEP_ROWS):
        needed = np.maximum(want["floor"][alive], best[alive, k - 1])
        alive = alive[lengths[alive] * np.maximum(bounds[at], -np.inf) + 1 >= needed]
        if not len(alive):
            break
        part = slice(at, at + STEP_ROWS)
        score = (wishes[alive] @ listed[part].T).astype(np.int64)
        fits = ((want["label"][alive][:, None] == label[part]) == same) & (want["anchor"][alive][:, None] != ids[part])
        fits &= (score >= want["floor"][alive][:, None]) & (score <= want["ceiling"][alive][:, None])
        score = np.concatenate([best[alive], np.where(fits, score, _LEAST)], axis=1)
        named = np.concatenate([who[alive], np.where(fits, ids[part], _MOST)], axis=1)
        first = np.lexsort((named, ~score), axis=1)[:, :k]
        best[alive], who[alive] = np.take_along_axis(score, first, 1), np.take_along_axis(named, first, 1)
    a, b = np.nonzero(best > _LEAST)
    return a, who[a, b], best[a, b]


_UNIT = ["length", "cluster", "chunk", "slice"]


def _mixed(ids: np.ndarray, into: np.ndarray) -> np.ndarray:
    """A number below ``into`` for each id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % into.astype(np.uint64)).astype(np.int32)


def _walked(rows: DataFrame, clusters: Clusters, wishes: DataFrame, same: bool, k: int, own: bool | None) -> DataFrame:
    """anchor_id, positive_id, ceiling, vec_id, score: the ``k`` best of each wish from the lists of its cluster.

    ``wishes`` has length, cluster, anchor_id, label, vector, positive_id, ceiling, floor. ``own``: only candidates whose nearest
    centre is the cluster's, only others, or (None) all."""
    needed = {length: np.full(len(c), np.inf) for length, c in clusters.centres.items()}
    chunks = {length: np.ones(len(c), np.int64) for length, c in clusters.centres.items()}
    for r in wishes.groupBy("length", "cluster").agg(F.min("floor").alias("floor"), F.count("*").alias("n")).collect():
        needed[r["length"]][r["cluster"]] = -np.inf if r["floor"] == _LEAST else r["floor"]
        chunks[r["length"]][r["cluster"]] = -(-r["n"] // CHUNK_MEMBERS)

    def goes(vectors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and cluster of each list entry, and its bound."""
        unit, norms = _directions(vectors)
        spread = clusters.spread[length]
        bounds = clusters.bounds(unit, norms, length)
        reach = np.maximum(bounds * spread["most"], bounds * spread["least"]) + 1 >= needed[length]
        if own is not None:
            near = clusters.angles(unit, length).argmin(axis=1)[:, None] == np.arange(bounds.shape[1])
            reach &= near if own else ~near
        row, cluster = np.nonzero(reach)
        return row, cluster, bounds[row, cluster]

    def sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, vectors in _by_length(batch):
                if length in needed:
                    at, n = np.unique(goes(vectors, length)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(length, pa.int32()), len(at)), pa.array(at.astype(np.int32)), pa.array(n)], ["length", "cluster", "n"])

    small_batches(rows.sparkSession)
    slices = {length: np.ones(len(c), np.int64) for length, c in clusters.centres.items()}
    candidates = rows.select("vec_id", "label", "vector")
    for r in candidates.select("vector").mapInArrow(sized, "length int, cluster int, n long").groupBy("length", "cluster").agg(F.sum("n").alias("n")).collect():
        slices[r["length"]][r["cluster"]] = -(-r["n"] // SLICE_ROWS)

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, which, vectors in _by_length(batch):
                if length not in needed:
                    continue
                row, cluster, bound = goes(vectors, length)
                ids = batch["vec_id"].to_numpy()[which[row]]
                piece = _mixed(ids, slices[length][cluster])
                for chunk in range(int(chunks[length].max())):
                    here = np.flatnonzero(chunks[length][cluster] > chunk)
                    for a in range(0, len(here), 10_000):
                        part = here[a : a + 10_000]
                        n = len(part)
                        columns = [pa.repeat(pa.scalar(length, pa.int32()), n), pa.array(cluster[part].astype(np.int32)), pa.repeat(pa.scalar(chunk, pa.int32()), n)]
                        columns += [pa.array(piece[part]), pa.array(ids[part]), batch["label"].take(pa.array(which[row[part]])), _packed(vectors[row[part]]), pa.array(bound[part])]
                        yield pa.RecordBatch.from_arrays(columns, [*_UNIT, "vec_id", "label", "vector", "bound"])

    listed = candidates.mapInArrow(entries, "length int, cluster int, chunk int, slice int, vec_id long, label string, vector binary, bound double")

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, cluster = batch["length"].to_numpy(), batch["cluster"].to_numpy()
            if not batch.num_rows:
                continue
            of = lambda sizes: np.array([sizes[a][b] for a, b in zip(length.tolist(), cluster.tolist())])
            chunk, copies = _mixed(batch["anchor_id"].to_numpy(), of(chunks)), of(slices)
            for a in range(0, batch.num_rows, 100):
                rows = np.repeat(np.arange(a, min(a + 100, batch.num_rows)), copies[a : a + 100])
                nth = np.concatenate([np.arange(c) for c in copies[a : a + 100]])
                copied = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*copied.columns, pa.array(chunk[rows]), pa.array(nth.astype(np.int32))], [*batch.schema.names, "chunk", "slice"])

    asked = wishes.select("length", "cluster", "anchor_id", "label", "vector", "positive_id", "ceiling", "floor")
    asked = asked.mapInArrow(members, "length int, cluster int, anchor_id long, label string, vector binary, positive_id long, ceiling long, floor long, chunk int, slice int")

    def meet(wish: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "ceiling", "vec_id", "score"]
        if not wish.num_rows or not rows.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        length = wish["length"][0].as_py()
        want = {c: wish[c].to_numpy() for c in ("ceiling", "floor")} | {"anchor": wish["anchor_id"].to_numpy(), "label": np.array(wish["label"].to_pylist(), object), "vector": _unpacked(wish["vector"], length)}
        a, ids, scores = _walk(np.array(rows["label"].to_pylist(), object), rows["vec_id"].to_numpy(), _unpacked(rows["vector"], length), rows["bound"].to_numpy(), want, same, k)
        at = pa.array(a)
        return pa.table([wish["anchor_id"].take(at), wish["positive_id"].take(at), wish["ceiling"].take(at), pa.array(ids), pa.array(scores)], names)

    return asked.groupBy(*_UNIT).cogroup(listed.groupBy(*_UNIT)).applyInArrow(meet, "anchor_id long, positive_id long, ceiling long, vec_id long, score long")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` is ``prepared``. An anchor's positives are its best rows of the same label. Of each, the negatives are the best rows of another
    label that score at least ``least_percent`` of the positive's score and no more than it."""
    rows = written(rows, "hard-negatives-rows")
    clusters, members = _fitted(rows.where("anchor").select("vec_id", "label", "vector"))
    open_wish = members.withColumns({"positive_id": F.col("anchor_id"), "ceiling": F.lit(int(_MOST)), "floor": F.lit(int(_LEAST))})
    seeds = written(_first(_walked(rows, clusters, open_wish, True, positives, True), ["anchor_id"], positives).drop("rank"), "hard-negatives-seeds")
    beat = seeds.groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == positives)
    wish = open_wish.join(beat, "anchor_id", "left").withColumn("floor", F.coalesce("kth", "floor")).drop("n", "kth")
    others = _walked(rows, clusters, wish, True, positives, False)
    best = written(_first(seeds.unionByName(others), ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("ceiling")), "hard-negatives-positives")
    # the least whole score that is least_percent of the positive's; no product leaves 64 bits
    of = F.col("ceiling")
    rest = F.pmod(of, F.lit(100))
    hundreds = F.call_function("div", of - rest, F.lit(100))
    floor = hundreds * least_percent + F.call_function("div", rest * least_percent + 99, F.lit(100))
    pairs = members.join(best, "anchor_id").withColumn("floor", floor).where(F.col("floor") <= of)
    hard = _first(_walked(rows, clusters, pairs, False, negatives, None), ["anchor_id", "positive_id"], negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("ceiling").alias("positive_score"), F.col("score").alias("negative_score"))
