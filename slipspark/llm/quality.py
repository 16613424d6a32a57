"""Quality rules: document statistics, fixed rules, and gradient-boosted trees in flat node arrays.

Every whole text gives a row of statistics. Trees are boosted on the logistic loss over a bounded labelled sample of these
rows (``SAMPLE``), with monotonic constraints: along a constrained feature no split may let the score fall (or rise), and
children stay within the bounds that the splits above set. The ensemble is flattened into arrays of feature, threshold,
children and leaf value, and a batch walks all trees level by level in numpy.

Defined results: a null or empty text has no words, all statistics 0, and fails the fixed rules. Without labels of both kinds
the trees keep everything. Repeated rows get the same answer; repeated labels of one document count each. Other columns
are carried along by ``statistics``, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipspark.llm.common import ASCII_SPACE, utf8, written

SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(b for b in range(256) if chr(b).isascii() and chr(b).isalpha() or b >= 0x80)
_DIGITS = bytes(range(0x30, 0x3A))
_UPPER = bytes(range(0x41, 0x5B))
_PUNCTUATION = b".,;:!?"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_letters", "n_punctuation", "n_distinct", "longest"]

#: Statistic and the direction in which quality may change with it: 1 up, -1 down, 0 either.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "line_length": 0,
    "upper_share": 0,
    "digit_share": -1,
    "letter_share": 1,
    "punctuation_share": 0,
    "distinct_share": 0,
    "log_longest": 0,
}

#: Labelled rows that the trees are fitted on (expected number; drawn by hash).
SAMPLE = 20_000


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """(words in 3-word windows that occur twice or more, distinct words)."""
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    if len(ids) < 3:
        return 0, len(numbers)
    pairs, pair = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, inverse, counts = np.unique(pair[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum()), len(numbers)


def counts_of(raw: bytes) -> list[int]:
    """The values of COUNTS."""
    words = raw.split()
    together = b"".join(words)
    chars = len(together) if together.isascii() else len(together.decode())
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(ASCII_SPACE):
            seen.add(line)
    repeated, distinct = repeat_words(words)
    count = lambda letters: len(raw) - len(raw.translate(None, letters))
    return [
        len(words), chars, count(SYMBOLS), dup, repeated, len(lines), count(_UPPER), count(_DIGITS), count(_LETTERS), count(_PUNCTUATION), distinct,
        max(map(len, words), default=0),
    ]


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of FEATURES from columns of COUNTS."""
    c = {k: np.asarray(v, float) for k, v in c.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    columns = [
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
        c["n_words"] / np.maximum(c["n_lines"], 1), c["n_upper"] / chars, c["n_digits"] / chars, c["n_letters"] / chars, c["n_punctuation"] / words, c["n_distinct"] / words,
        np.log1p(c["longest"]),
    ]
    return np.stack(columns, axis=1)


def statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Every row with the counts of its whole text."""
    rows = docs.withColumn("__raw", utf8(text)).drop(*COUNTS)
    final = rows.drop("__raw").schema
    for name in COUNTS:
        final = final.add(name, T.LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = np.array([counts_of(raw.as_py()) for raw in part.column("__raw")], np.int64).reshape(-1, len(COUNTS))
                names = [n for n in part.schema.names if n != "__raw"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(made[:, i]) for i in range(len(COUNTS)))], names=[*names, *COUNTS])

    return rows.mapInArrow(count, final)


@dataclass
class Trees:
    """All trees in flat arrays. A leaf is its own child on both sides; roots lists where each tree begins."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], *, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Second-order boosting on binned features, with monotonic constraints."""
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if not len(y) or y.min() == y.max():
        return Trees(20.0, *(np.zeros(0, t) for t in (int, int, float, int, int, float)), depth)
    base = float(np.log(y.mean() / (1 - y.mean())))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        weight = lambda gs, hs: np.clip(-gs / (hs + ridge), low, high)
        gain_of = lambda gs, hs, w: -(2 * gs * w + (hs + ridge) * w * w)
        g_all, h_all = g[rows].sum(), h[rows].sum()
        own = float(weight(g_all, h_all))
        me = len(nodes)
        nodes.append([0, 0.0, me, me, own * rate])
        best = (1e-6, None)
        for f in range(x.shape[1]) if level and len(rows) >= 2 * least else ():
            size = len(edges[f]) + 1
            b = binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
            wl, wr = weight(gl, hl), weight(g_all - gl, h_all - hl)
            gain = gain_of(gl, hl, wl) + gain_of(g_all - gl, h_all - hl, wr) - gain_of(g_all, h_all, own)
            allowed = (nl >= least) & (len(rows) - nl >= least) & (directions[f] * (wr - wl) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), (f, k, float(wl[k]), float(wr[k])))
        if best[1]:
            f, k, wl, wr = best[1]
            middle = (wl + wr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[directions[f]]
            goes_left = binned[rows, f] <= k
            left = grow(rows[goes_left], g, h, level - 1, *bounds[0])
            right = grow(rows[~goes_left], g, h, level - 1, *bounds[1])
            nodes[me][:4] = [f, float(edges[f][k]), left, right]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf))
        flat = np.array(nodes[first:])
        node = np.zeros(len(y), int)
        for _ in range(depth):
            node = np.where(x[np.arange(len(y)), flat[node, 0].astype(int)] <= flat[node, 1], flat[node, 2], flat[node, 3]).astype(int) - first
        margin += flat[node, 4]
    flat = np.array(nodes)
    return Trees(base, np.array(roots), flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], depth)


def training_rows(stats: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about ``sample`` labelled documents, drawn by hash."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("__y"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = stats.select("doc_id", *COUNTS).join(known, "doc_id").orderBy("doc_id").toPandas()
    return features({c: got[c].to_numpy() for c in COUNTS}), got["__y"].to_numpy(float)


RESULT = ["quality_score", "base_failed", "kept"]
#: Documents with a lower probability of good quality go.
LEAST_SCORE = 0.5


def rate(stats: DataFrame, trees: Trees, *, least_score: float = LEAST_SCORE) -> DataFrame:
    """Rows of statistics with ``quality_score``, ``base_failed`` (fixed rules) and ``kept``."""
    shared = stats.sparkSession.sparkContext.broadcast(trees)  # a few thousand nodes

    @F.pandas_udf(T.DoubleType())
    def score(c: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.score(features({k: c[k].to_numpy() for k in COUNTS})))

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rated = stats.drop(*RESULT).withColumn("quality_score", score(F.struct(*COUNTS))).withColumn("base_failed", failed)
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= least_score))


def quality_rules(docs: DataFrame, labels: DataFrame, *, text: str = "text") -> DataFrame:
    """Statistics, score and verdict of every document; the trees are fitted on the labelled ones."""
    stats = written(statistics(docs.select("doc_id", text), text=text).drop(text), "quality-stats")
    return rate(stats, fit(*training_rows(stats, labels), list(FEATURES.values())))
