"""N-gram Jaccard join by T-occurrence search over inverted lists of shingles.

A text is the set of its distinct shingles of ``width`` words. Two texts link when their sets have a Jaccard similarity of
``percent`` / 100 or more. A text of n shingles links only with texts that share at least T = ceil(n percent / 100) of them. In the manner of DivideSkip the
T - k most frequent lists of a text are set aside as long ones, and its other n - T + k lists, the short ones, are merged:
who occurs in fewer than k of them can't reach T. Only who does is probed for in the long lists, by binary search in sorted
sets, until the overlap is reached or out of reach.

How this runs on Spark:

* Texts of equal sets are one class, found by a 128-bit key with a combining aggregation, so a group of copies of any size
  is one node from here on.
* Lists are put in one order for all texts: shingles found often come last, by a bounded table of counts, ties by hash. The
  order steers the work only; any order gives the same result.
* Entries of short lists are range-partitioned by (shingle, class) and streamed in that order, so the merge is Spark's sort,
  a list of any length spreads over partitions, and lists of one class vanish where they are read.
* Lists of up to ``SHORT_LIST`` classes give pairs, counted against k. From a longer one each class is compared with two
  pivots only. Most of such a list is one group of near copies, and the pivots join it. Where a longer list still touches
  several components, everything outside the largest one is compared with all of it by small sketches, in blocks of bounded
  size; what these leave open is probed for. So no group gives all its pairs, and no link between different texts is lost.
* What moves between tasks is entries, sketches and pairs. Sets are made only of texts that a pair is still open for.
* Components contract: every node hooks to its smallest neighbour, and edges are rewritten, until none is left.

Defined results: a null or empty text, or one of white space only, has no shingle, links with nothing and is its own
component. Fewer than ``width`` words are one shingle, the whole sequence. Repeated rows are rows of one class. A row without id
takes the smallest id of its component, null if there is none. Rows that share an id are rows of their own. An empty table
gives an empty result. Other columns are carried along by ``distinct_documents``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipspark.llm.common import claim, partitions, small_batches, utf8, written

#: The contract of op6. The pipeline passes its own.
WIDTH, PERCENT = 4, 85
#: Lists up to this length give all their pairs.
SHORT_LIST = 64
#: Bytes of coarse sketches in a block of the search within a long list, on either side, and what else a row holds.
BLOCK_BYTES, ROW_BYTES = 4_000_000, 40
#: Shingles whose counts are known to every task, the most frequent first, and the count from which they matter.
ORDERED, OFTEN = 300_000, 16
#: Cells of the filter that tells a scan which texts to return sets of; others that slip through do no harm.
FILTER_BITS = 1 << 25

_A = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = raw.lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\n" + b" ".join(words))] if words else [], np.uint64).view(np.int64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    h = w[: len(w) - width + 1].copy()
    for k in range(1, width):
        h *= _A
        h += w[k : len(w) - width + 1 + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def required(n: int, percent: int = PERCENT) -> int:
    """Shingles that a text of n must share with any that it links with."""
    return -(-percent * n // 100)


def short_hits(n: int, percent: int = PERCENT) -> int:
    """k: short lists of a text of n in which a partner must occur."""
    return max(1, min(4, required(n, percent)))


def linked(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets: the smaller one is probed for in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def sketch(members: np.ndarray) -> np.ndarray:
    """How many members each of a power of two of cells holds, half as many cells as members or more; 255 stands for that or more."""
    cells = 1 << max(3, (len(members) // 2).bit_length())
    return np.minimum(np.bincount(members & (cells - 1), minlength=cells), 255).astype(np.uint8)


def coarse(fine: np.ndarray) -> np.ndarray:
    """The same with a quarter of the cells, but eight at least."""
    parts = min(4, len(fine) // 8)
    return np.where((parts_of := fine.reshape(parts, -1)).max(axis=0) == 255, 255, np.minimum(parts_of.sum(axis=0, dtype=np.int64), 255)).astype(np.uint8)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """No two sets of these sketches have more common members."""
    while len(a) != len(b):  # the cells of the coarser one are sums of the finer one's
        if len(a) > len(b):
            a, b = b, a
        b = b.reshape(2, -1).astype(np.int64).sum(axis=0) if (b < 255).all() else np.full(len(b) // 2, 255)
    if (a >= 255).any() or (b >= 255).any():
        return 1 << 62
    return int(np.minimum(a, b).sum())


class Index:
    """Inverted lists of a block of sets: the search for one machine, which the tables of ``classes`` spread over tasks."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        self.owner = owner[order]
        self.keys, self.starts = np.unique(flat, return_index=True)
        self.ends = np.append(self.starts[1:], len(flat)).astype(int)

    def search(self, query: np.ndarray) -> list[int]:
        """Numbers of the sets that link with the query, by DivideSkip."""
        n = len(query)
        least = required(n, self.percent)
        if not len(self.keys) or not n:
            return []
        at = np.searchsorted(self.keys, query)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == query]
        if len(at) < least:
            return []
        at = at[np.argsort(self.ends[at] - self.starts[at], kind="stable")]
        long = max(0, min(least - short_hits(n, self.percent), len(at)))
        split = len(at) - long
        merged = [self.owner[self.starts[i] : self.ends[i]] for i in at[:split]]
        counts = np.bincount(np.concatenate(merged) if merged else np.zeros(0, int), minlength=len(self.sizes))
        found = np.flatnonzero(counts >= max(1, least - long))
        for done, i in enumerate(at[split:]):
            if not len(found):
                break
            own = self.owner[self.starts[i] : self.ends[i]]  # sorted: candidates are probed for
            place = np.searchsorted(own, found)
            place[place == len(own)] = 0
            counts[found] += own[place] == found
            found = found[counts[found] + (long - done - 1) >= least]
        return [int(c) for c in found if linked(int(counts[c]), n, int(self.sizes[c]), self.percent)]


def _features(width: int) -> Callable:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text its class and size; per shingle that different texts of a batch share, how many do."""
        claim("ngram_join", _HASHES.clear)
        names = ["doc_id", "row", "n", "k1", "k2", "token", "count"]
        for batch in batches:
            n, keys, fresh, seen = [], [], [], set()
            for raw in batch.column("raw"):
                s = shingles(raw.as_py(), width)
                key = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                keys.append(key)
                if key not in seen:
                    seen.add(key)
                    fresh.append(s)
            pair = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())], names=names
            )
            token = np.concatenate([*fresh, np.zeros(0, np.int64)])
            del fresh
            token.sort()
            token, count = np.unique(token[np.flatnonzero(np.concatenate([token[1:] == token[:-1], [False]]))], return_counts=True)
            count = (count + 1).astype(np.int64)
            size = len(token)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(size, batch.schema.field("doc_id").type), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.array(token), pa.array(count)], names=names
            )

    return features


def _short_lists(shared, width: int, percent: int) -> Callable:
    """Entries (token, class, n) of the short lists of every text that can link with a different one."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join", _HASHES.clear)
        often, counts = shared.value
        for batch in batches:
            tokens, owners, sizes, seen = [], [], [], set()
            for raw in batch.column("raw"):
                s = shingles(raw.as_py(), width)
                n = len(s)
                short = n - required(n, percent) + short_hits(n, percent)
                if 100 * n < percent * (n + 1):  # so small that any other set is too far
                    continue
                key = int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0])
                if key in seen:
                    continue
                seen.add(key)
                if len(often):
                    at = np.searchsorted(often, s)
                    at[at == len(often)] = 0
                    frequency = np.where(often[at] == s, counts[at], 0)
                    s = s[np.lexsort((s, frequency))]
                tokens.append(s[:short])
                owners.append(np.full(len(tokens[-1]), key, np.int64))
                sizes.append(np.full(len(tokens[-1]), n, np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*x, np.zeros(0, t)])) for x, t in ((tokens, np.int64), (owners, np.int64), (sizes, np.int32))], names=["token", "k1", "n"]
            )

    return entries


def _shared_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted entries, those whose list has a second class, and the partition's first and last list, which may go on
    elsewhere. Repeated entries go. One entry is held between batches."""
    held: tuple | None = None  # last entry, and whether its list is known to matter

    def out(token, k1, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(token, np.int64)), pa.array(np.asarray(k1, np.int64)), pa.array(np.asarray(n, np.int32))], names=["token", "k1", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        token, k1, n = (batch.column(c).to_numpy() for c in ("token", "k1", "n"))
        matters = True  # the partition's first list
        if held is not None:
            token, k1, n = np.insert(token, 0, held[0]), np.insert(k1, 0, held[1]), np.insert(n, 0, held[2])
            matters = held[3]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (k1[1:] != k1[:-1])])
        token, k1, n = token[new], k1[new], n[new]
        same = token[1:] == token[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        keep |= (token == token[0]) & matters
        held = (token[-1], k1[-1], n[-1], bool(keep[-1]))
        if keep[:-1].any():
            yield out(token[:-1][keep[:-1]], k1[:-1][keep[:-1]], n[:-1][keep[:-1]])
    if held is not None:
        yield out([held[0]], [held[1]], [held[2]])


def _in_reach(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _hits(n: str, percent: int):
    """short_hits in columns."""
    return F.greatest(F.lit(1), F.least(F.lit(4), F.ceil(F.col(n) * percent / 100)))


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the label is the same throughout a component.

    Node numbers are hashes, so hooking to the smallest neighbour shrinks what is left by a factor each round.
    """
    edges = written(edges.where("a <> b").select("a", "b"), f"{purpose}-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("parent"))
        hooks = written(hooks, f"{purpose}-hooks")
        if labels is None:
            labels = hooks.withColumnRenamed("parent", "label")
        else:
            moved = labels.join(hooks.withColumnRenamed("node", "label"), "label", "left")
            labels = written(moved.select("node", F.coalesce("parent", "label").alias("label")), f"{purpose}-labels")
        one = edges.join(hooks.toDF("a", "x"), "a")
        two = one.join(hooks.toDF("b", "y"), "b")
        edges = written(two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{purpose}-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """A bit per cell that holds the hash of a (doc_id, row): FILTER_BITS / 8 bytes, whatever the number of nodes."""
    cell = F.pmod(F.xxhash64("doc_id", "row"), F.lit(FILTER_BITS))
    words = nodes.select(cell.alias("cell")).groupBy(F.shiftright("cell", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 32 as int))")).alias("bits")).toArrow()
    made = np.zeros(FILTER_BITS // 32, np.uint32)
    made[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return made


def _of_nodes(source: DataFrame, rows: DataFrame, nodes: DataFrame, made: Callable, width: int, schema: str, purpose: str) -> DataFrame:
    """One row per class of ``nodes``, which ``made`` gives from the shingles of its text. Other texts are passed over unread."""
    chosen = rows.join(nodes, "k1", "left_semi").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("k1", "r.doc_id", "r.row")
    wanted = source.sparkSession.sparkContext.broadcast(_filter_of(chosen))
    texts = source.select("raw", F.pmod(F.xxhash64("doc_id", "row"), F.lit(FILTER_BITS)).alias("cell"))
    return written(texts.mapInArrow(_of_wanted(wanted, width, made), schema).join(nodes, "k1", "left_semi").dropDuplicates(["k1"]), purpose)


def _of_wanted(shared, width: int, made: Callable) -> Callable:
    def of_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join", _HASHES.clear)
        bits = shared.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            wanted = np.flatnonzero((bits[cell >> 5] >> (cell & 31).astype(np.uint32)) & 1)
            for at in range(0, len(wanted), 256):
                found = [shingles(raw.as_py(), width) for raw in batch.column("raw").take(pa.array(wanted[at : at + 256]))]
                key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in found), np.int64).reshape(-1, 2)
                columns = made(found)
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), *columns.values()], names=["k1", *columns])

    return of_wanted


def _sketched(found: list[np.ndarray]) -> dict[str, pa.Array]:
    fine = [sketch(s) for s in found]
    return {
        "n": pa.array([len(s) for s in found], pa.int32()),
        "sketch": pa.array([s.tobytes() for s in fine], pa.binary()),
        "coarse": pa.array([coarse(s).tobytes() for s in fine], pa.binary()),
    }


def _members(found: list[np.ndarray]) -> dict[str, pa.Array]:
    return {"members": pa.array([s.tobytes() for s in found], pa.binary())}


def _likely(percent: int) -> Callable:
    """Of candidates with sizes and sketches, those that the sketches don't rule out."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")))
            good = [linked(min(na, nb, overlap_bound(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))), na, nb, percent) for na, nb, x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return likely


def _verified(percent: int) -> Callable:
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                good.append(linked(overlap(x, y), len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verified


def _bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``overlap_bound`` of sketches row by row; those of a side have the same number of cells."""
    full = (a == 255).any(axis=1) | (b == 255).any(axis=1)
    if a.shape[1] < b.shape[1]:
        a, b = b, a
    if a.shape[1] > b.shape[1]:
        a = a.reshape(len(a), -1, b.shape[1]).sum(axis=1, dtype=np.int64)
    return np.where(full, 1 << 62, np.minimum(a, b).sum(axis=1, dtype=np.int64))


class _Side:
    """Entries of lists in the order of (list, n), and their sketches by number of cells."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["token", "n"], kind="stable")
        self.token, self.k1, self.n, self.label, self.outside = (rows[c].to_numpy() for c in ("token", "k1", "n", "label", "outside"))
        self.n = self.n.astype(np.int64)
        sketches = rows["coarse"].to_numpy()
        self.cells = np.fromiter(map(len, sketches), np.int64, len(rows))
        self.at, self.by_cells = np.zeros(len(rows), np.int64), {}
        for c in np.unique(self.cells):
            own = np.flatnonzero(self.cells == c)
            self.at[own] = np.arange(len(own))
            self.by_cells[c] = np.frombuffer(b"".join(sketches[own]), np.uint8).reshape(len(own), c)


def _bounds_of(queries: _Side, q: np.ndarray, targets: _Side, t: np.ndarray) -> np.ndarray:
    most = np.zeros(len(q), np.int64)
    for c, x in queries.by_cells.items():
        for d, y in targets.by_cells.items():
            own = np.flatnonzero((queries.cells[q] == c) & (targets.cells[t] == d))
            some = max(1, 16_000_000 // int(max(c, d)))
            for at in range(0, len(own), some):
                part = own[at : at + some]
                most[part] = _bounds(x[queries.at[q[part]]], y[targets.at[t[part]]])
    return np.minimum(most, np.minimum(queries.n[q], targets.n[t]))


def _search_lists(percent: int) -> Callable:
    def search_lists(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs of queries with targets of other components in the same list that their coarse sketches don't rule out."""
        targets, queries = _Side(group[~group["is_query"]]), _Side(group[group["is_query"]])
        lists = np.unique(targets.token)
        nth, own = np.searchsorted(lists, targets.token), np.searchsorted(lists, queries.token)
        known = own < len(lists)
        known[known] = lists[own[known]] == queries.token[known]
        order = (nth << 32) + targets.n
        low = np.searchsorted(order, (own << 32) + -(-percent * queries.n // 100))
        high = np.where(known, np.searchsorted(order, (own << 32) + 100 * queries.n // percent, "right"), low)
        ends = np.cumsum(np.maximum(high - low, 0))
        found = [np.zeros((4, 0), np.int64)]
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")))
            count = np.maximum(high[at:to] - low[at:to], 0)
            q = np.repeat(np.arange(at, to), count)
            t = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + low[q]
            # of two that are both queries and targets, one asks
            asked = (targets.label[t] != queries.label[q]) & (~targets.outside[t] | (targets.k1[t] > queries.k1[q]))
            q, t = q[asked], t[asked]
            most = _bounds_of(queries, q, targets, t)
            good = 100 * most >= percent * (queries.n[q] + targets.n[t] - most)
            q, t = q[good], t[good]
            found.append(np.stack([queries.k1[q], queries.label[q], targets.k1[t], targets.label[t]]))
            at = to
        return pd.DataFrame(dict(zip(("a", "la", "b", "lb"), np.concatenate(found, axis=1)))).drop_duplicates()

    return search_lists


def _possible(candidates: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that sketches don't rule out. Sketches are a sixteenth of the sets."""
    seen = [sketches.select(F.col("k1").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    return written(candidates.select("a", "b").join(seen[0], "a").join(seen[1], "b").mapInArrow(_likely(percent), "a long, b long"), "join-likely")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that link."""
    with_a = pairs.select("a", "b").join(sets.select(F.col("k1").alias("a"), F.col("members").alias("sa")), "a")
    with_both = with_a.join(sets.select(F.col("k1").alias("b"), F.col("members").alias("sb")), "b")
    return written(with_both.mapInArrow(_verified(percent), "a long, b long"), "join-links")


def classes(docs: DataFrame, *, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): per row its doc_id, text hash, number of shingles and class; per class that links, its component."""
    spark = docs.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    source = docs.select("doc_id", utf8(text).alias("raw")).withColumn("row", F.xxhash64("raw"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = written(source.mapInArrow(_features(width), f"doc_id {id_type}, row long, n int, k1 long, k2 long, token long, count long"), "join-features")
    rows = found.where("n is not null").select("doc_id", "row", "n", "k1", "k2")

    often = found.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).where(f"count >= {OFTEN}")
    often = often.orderBy(F.desc("count"), "token").limit(ORDERED).toArrow()  # steers the order of lists, nothing else
    token, count = (often.column(c).to_numpy().astype(t) for c, t in (("token", np.int64), ("count", np.int64)))
    by_token = np.argsort(token)
    order = sc.broadcast((token[by_token], count[by_token].astype(np.int32)))

    entries = written(source.select("raw").mapInArrow(_short_lists(order, width, percent), "token long, k1 long, n int"), "join-entries")
    ranged = entries.repartitionByRange(partitions(spark), "token", "k1").sortWithinPartitions("token", "k1")
    lists = written(ranged.mapInArrow(_shared_entries, "token long, k1 long, n int"), "join-lists")
    sizes = written(lists.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("k1", "n")).alias("low"), F.max(F.struct("k1", "n")).alias("high")).where("size > 1"), "join-sizes")

    short = lists.join(sizes.where(f"size <= {SHORT_LIST}").select("token"), "token")
    left, right = (short.select("token", F.col("k1").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    pairs = left.join(right, "token").where("a < b").where(_in_reach("na", "nb", percent))
    # a pair may also meet in longer lists, where it isn't counted: then the short ones alone don't decide
    long = lists.join(sizes.where(f"size > {SHORT_LIST}"), "token")
    in_long = long.groupBy("k1").agg(F.count("*").alias("m"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("hits"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    counted = counted.join(in_long.select(F.col("k1").alias("a"), F.col("m").alias("ma")), "a", "left").join(in_long.select(F.col("k1").alias("b"), F.col("m").alias("mb")), "b", "left")
    reach = F.col("hits") + F.least(F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0))) >= F.least(_hits("na", percent), _hits("nb", percent))
    pivots = long.select("k1", "n", F.explode(F.array("low", "high")).alias("p")).where("k1 <> p.k1").where(_in_reach("n", "p.n", percent))
    pivots = pivots.select(F.least("k1", "p.k1").alias("a"), F.greatest("k1", "p.k1").alias("b"))
    candidates = written(counted.where(reach).select("a", "b").unionAll(pivots).distinct(), "join-candidates")

    nodes = candidates.select(F.col("a").alias("k1")).unionAll(candidates.select("b")).unionAll(long.select("k1")).distinct()
    sketches = _of_nodes(source, rows, written(nodes, "join-nodes"), _sketched, width, "k1 long, n int, sketch binary, coarse binary", "join-sketches")
    sets_of = lambda pairs: _of_nodes(source, rows, written(pairs.select(F.col("a").alias("k1")).unionAll(pairs.select("b")).distinct(), "join-nodes"), _members, width, "k1 long, members binary", "join-sets")

    # most pairs are ruled out by sketches; sets are made of the others only
    candidates = _possible(candidates, sketches, percent)
    links = _links(candidates, sets_of(candidates), percent)
    labels = components(links, "join")

    more = _search_long(long.select("token", "k1", "n"), sketches, sets_of, labels, percent)
    if more is not None:
        labels = components(links.unionAll(more), "join-all")
    return rows, labels


def _spare(n: str, percent: int):
    """How many of the long lists that two texts share can be passed over: all but one of the hits that a text of n needs with
    the smallest text in its reach."""
    least = F.ceil(F.ceil(F.col(n) * percent / 100) * percent / 100)
    return F.greatest(F.lit(1), F.least(F.lit(4), least)) - 1


def _mixed(members: DataFrame) -> DataFrame:
    """Entries of lists that touch several components, with the size of the list and its first member."""
    lists = members.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("k1").alias("first"), F.count("*").alias("size"))
    return members.join(lists.where("lo <> hi").select("token", "first", "size"), "token")


def _search_long(long: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], labels: DataFrame, percent: int) -> DataFrame | None:
    """Links that pivots left open in long lists (token, k1, n); None if no two texts of different components can link there.

    A pair that meets in a short list has been counted. Any other one shares all the hits it needs, k, in lists of several
    components. If each text passes over its k - 1 longest of these, lists taken in one order for all, the shortest list that the two
    share is still among those of both. Each such list is searched for itself, so what moves grows with the entries and not with
    whole texts times texts; a list is dealt in blocks of bounded size.
    """
    known = labels.select(F.col("node").alias("k1"), "label")
    members = long.join(known, "k1", "left").withColumn("label", F.coalesce("label", "k1"))
    members = written(_mixed(members), "join-mixed")
    if members.isEmpty():
        return None
    rank = F.row_number().over(Window.partitionBy("k1").orderBy(F.desc("size"), "token"))
    needed = members.withColumn("rank", rank).where(F.col("rank") > _spare("n", percent)).select("token", "k1", "label")
    entries = _mixed(needed).select("token", "k1", "label").join(sketches.select("k1", "n", "coarse"), "k1")
    entries = written(entries.withColumn("bytes", F.length("coarse") + ROW_BYTES), "join-needed")
    share = entries.groupBy("token", "label").agg(F.sum("bytes").alias("m"))
    largest = share.groupBy("token").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("total"))
    at_least_one = lambda size: F.greatest(F.lit(1).cast("long"), F.ceil(size / BLOCK_BYTES))
    sized = largest.select("token", F.col("top.label").alias("top"), at_least_one(F.col("total")).alias("blocks"), at_least_one(F.col("total") - F.col("top.m")).alias("askers"))
    every = entries.join(sized, "token").withColumn("outside", F.col("label") != F.col("top"))
    place = F.pmod(F.xxhash64("k1"), F.col("blocks"))
    turn = F.pmod(F.xxhash64("k1", F.lit(1)), F.col("askers"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # lists of one block go together, up to about a block's bytes; longer ones are on their own
    together = F.pmod(F.xxhash64("token"), F.lit(max(1, -(-(entries.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES))))
    part = F.when(F.col("blocks") > 1, F.col("token")).otherwise(together)
    columns = ["token", "k1", "n", "label", "coarse", "outside", (F.col("blocks") > 1).alias("alone"), part.alias("part")]
    targets = every.select(*columns, F.lit(False).alias("is_query"), place.alias("block"), upto("askers").alias("turn"))
    queries = every.where("outside").select(*columns, F.lit(True).alias("is_query"), upto("blocks").alias("block"), turn.alias("turn"))
    pairs = targets.unionByName(queries).groupBy("alone", "part", "block", "turn").applyInPandas(_search_lists(percent), "a long, la long, b long, lb long")
    pairs = written(pairs.distinct(), "join-met")
    if pairs.isEmpty():
        return None
    possible = pairs.join(_possible(pairs, sketches, percent), ["a", "b"])
    possible = written(possible, "join-possible")
    sets = sets_of(possible)
    # one link joins a text with a component as well as all would: one pair of the two is tried, and the others where it fails
    first = possible.groupBy("a", "lb").agg(F.min("b").alias("b"))
    found = _links(first, sets, percent)
    done = found.join(possible, ["a", "b"]).select("a", "lb")
    return found.unionAll(_links(possible.join(first, ["a", "b"], "left_anti").join(done, ["a", "lb"], "left_anti"), sets, percent))


def join(docs: DataFrame, *, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, n_shingles, class_size, component_id, component) for every row of ``docs``.

    ``row`` is a hash of the text; ``component`` tells components apart even where ids are missing or repeated (null
    for texts without shingles).
    """
    rows, labels = classes(docs, text=text, width=width, percent=percent)
    ids = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"))
    ids = ids.join(labels.withColumnRenamed("node", "k1"), "k1", "left").withColumn("component", F.coalesce("label", "k1"))
    ids = written(ids.select("k1", "k2", "least", "class_size", "component"), "join-classes")
    smallest = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    named = ids.join(smallest, "component").select("k1", "k2", "class_size", "component_id", "component")
    columns = ["doc_id", "row", F.col("n").cast("long").alias("n_shingles")]
    linked_rows = rows.where("n > 0").join(named, ["k1", "k2"]).select(*columns, "class_size", "component_id", "component")
    empty = rows.where("n = 0").select(*columns, F.lit(1).cast("long").alias("class_size"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return linked_rows.unionByName(empty)


def distinct_documents(docs: DataFrame, *, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id (then text hash), columns unchanged.

    Texts without shingles all stay. Rows equal in id and text are one document.
    """
    joined = written(join(docs, text=text, width=width, percent=percent).select("doc_id", "row", "component"), "join-rows")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    stay = joined.where("component is not null").groupBy("component").agg(F.min(first).alias("first")).select("first.doc_id", "first.row")
    stay = stay.unionAll(joined.where("component is null").select("doc_id", "row")).toDF("__id", "__hash").distinct()
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("doc_id").alias("__doc_id"), F.xxhash64(utf8(text)).alias("__row"))
    kept = bare.join(stay, (F.col("__row") == F.col("__hash")) & F.col("__doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["__doc_id", "__row"]).select("__doc.*")
