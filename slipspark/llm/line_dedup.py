"""Line dedup: hashes in range order, first occurrences streamed, decisions returned as compressed bitmaps.

Every line of at least ``min_chars`` gives a row (hash, document, position), without its text. The rows are range
partitioned and sorted by all of these, so a line that a third of all documents hold spreads over many partitions, and a
partition streams through its runs with one row of state. What a run that crosses partitions needs (its first document,
and whether it has two) is one small row per partition. Repeats come back as one bitmap per document, and the texts are
read once more to drop what it marks.

Defined results: a null or empty text is one empty line. Rows of one doc_id are one document: a line that only they share
is no repeat, and each of them keeps its lines where that id is the smallest. Documents without id are one document, behind
all others. Columns named like a result are replaced, others are carried along by ``dedup_lines``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipspark.llm.common import ASCII_SPACE, partitions, utf8, written

#: Behind every doc_id.
LAST = (1 << 63) - 1

KEYS = "h1 long, h2 long, doc long, row long, pos int, n int"


def lines_of(raw: bytes) -> list[bytes]:
    return raw.split(b"\n")


def key_of(line: bytes) -> bytes:
    return line.strip(ASCII_SPACE).lower()


def _keys(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                halves, doc, row, pos, n = [], [], [], [], []
                for d, r, raw in zip(part.column("doc").to_pylist(), part.column("row").to_pylist(), part.column("raw")):
                    lines = lines_of(raw.as_py())
                    for i, line in enumerate(lines):
                        key = key_of(line)
                        if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
                            continue
                        halves.append(xxhash.xxh3_128_digest(key))
                        doc.append(d)
                        row.append(r)
                        pos.append(i)
                        n.append(len(lines))
                pair = np.frombuffer(b"".join(halves), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int32())],
                    names=["h1", "h2", "doc", "row", "pos", "n"],
                )

    return keys


MARKS = "kind byte, h1 long, h2 long, doc long, row long, pos int, n int"
DROP, OPEN, EDGE = 0, 1, 2


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the sorted rows of a partition, holding one run's key and first document.

    DROP: a line of a document behind the first of its run. OPEN: a line of the first document of the partition's first
    run, which stays only if no partition before holds that run. EDGE: last run of the partition with its first document.
    """
    names = [f.split()[0] for f in MARKS.split(", ")]

    def out(kind, *columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int8)), *map(pa.array, columns)], names=names)

    opening = here = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, row, pos, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in names[1:])
        starts = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        firsts = doc[starts].copy()
        if here is not None and here[:2] == (h1[0], h2[0]):
            firsts[0] = here[2]
        if opening is None:
            opening = h1[0], h2[0], doc[0]
        here = h1[-1], h2[-1], firsts[-1]
        drop = doc != np.repeat(firsts, np.diff(np.concatenate([starts, [len(doc)]])))
        if drop.any():
            yield out(DROP, *(c[drop] for c in (h1, h2, doc, row, pos, n)))
        if (h1[0], h2[0]) == opening[:2]:
            still = (h1 == opening[0]) & (h2 == opening[1]) & (doc == opening[2])
            if still.any():
                yield out(OPEN, *(c[still] for c in (h1, h2, doc, row, pos, n)))
    if here is not None:
        yield out(EDGE, *(np.array([v]) for v in here), np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(1, np.int32))


@F.pandas_udf(T.BinaryType())
def _bitmap(positions: pd.Series, n: pd.Series) -> pd.Series:
    made = []
    for p, size in zip(positions, n):
        bits = np.ones(size, bool)
        bits[p] = False
        made.append(zlib.compress(np.packbits(bits).tobytes(), 6))
    return pd.Series(made)


def keep_bits(packed: bytes, n: int) -> np.ndarray:
    """Whether each of n lines stays."""
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).astype(bool)


def _identified(docs: DataFrame, text: str) -> DataFrame:
    rows = docs.withColumn("__raw", utf8(text))
    return rows.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__row", F.xxhash64("__raw"))


def keep_bitmaps(docs: DataFrame, *, min_chars: int = 10, text: str = "text") -> DataFrame:
    """(doc, row, n_lines, keep): for each document row that loses lines, a compressed bit per line; no text.

    ``doc`` is the id (``LAST`` where null) and ``row`` a hash of the text, which tells rows of one id apart. Rows that are
    not in the result keep all their lines.
    """
    spark = docs.sparkSession
    rows = _identified(docs, text).select(F.col("__doc").alias("doc"), F.col("__row").alias("row"), F.col("__raw").alias("raw"))
    keys = written(rows.mapInArrow(_keys(min_chars), KEYS), "line-keys")  # else the sampling for the ranges reads the texts once more
    order = ["h1", "h2", "doc", "row", "pos"]
    marks = written(keys.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_marks, MARKS), "line-marks")
    edges = marks.where(f"kind = {EDGE}").groupBy("h1", "h2").agg(F.min("doc").alias("least"))  # at most a row per partition
    late = marks.where(f"kind = {OPEN}").join(F.broadcast(edges), ["h1", "h2"]).where("least < doc")
    drops = marks.where(f"kind = {DROP}").select("doc", "row", "pos", "n").unionAll(late.select("doc", "row", "pos", "n"))
    found = drops.groupBy("doc", "row").agg(F.collect_set("pos").alias("pos"), F.max("n").alias("n_lines"))
    return found.select("doc", "row", "n_lines", _bitmap("pos", "n_lines").alias("keep"))


RESULT = ["kept_text", "n_lines", "n_dropped"]


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, text: str = "text") -> DataFrame:
    """Every row with ``kept_text`` (its lines that stay, joined), ``n_lines`` and ``n_dropped``."""
    bitmaps = keep_bitmaps(docs, min_chars=min_chars, text=text).select(
        F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("n_lines").alias("__n"), F.col("keep").alias("__keep")
    )
    rows = _identified(docs.drop(*RESULT), text).join(bitmaps, ["__doc", "__row"], "left").drop("__doc", "__row", "__n")
    final = rows.drop("__raw", "__keep").schema
    for field in T.StructType.fromDDL("kept_text string, n_lines long, n_dropped long").fields:
        final = final.add(field)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, n_lines, n_dropped = [], [], []
                for raw, keep in zip(part.column("__raw"), part.column("__keep")):
                    raw, keep = raw.as_py(), keep.as_py()
                    lines = lines_of(raw)
                    kept = lines if keep is None else [x for x, k in zip(lines, keep_bits(keep, len(lines))) if k]
                    texts.append((raw if keep is None else b"\n".join(kept)).decode())
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                names = [n for n in part.schema.names if n not in ("__raw", "__keep")]
                columns = [part.column(n) for n in names] + [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *RESULT])

    return rows.mapInArrow(apply, final)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
