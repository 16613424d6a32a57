"""Benchmark decontamination: one automaton over all test windows, every text scanned once.

The normal form of a text is its words, lower-cased (A-Z only), one blank between them and one at either end. All windows
of all benchmark items go into one Aho-Corasick automaton over that form, so a text of any length is scanned once whatever
the number of items. Word numbers lead from a hit back to byte and character offsets of the original.

Defined results: a null or empty text has no words and no hits. An item without words has no window. An item of fewer
words than ``window`` is one window. Rows of one item_id are one item, a window counts for every item that holds it, and
items without id count as one named ``null``. An empty benchmark table hits nothing. Repeated document rows are scanned
each for itself, and columns of the input other than those named are carried along by ``scan`` untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipspark.llm.common import claim, small_batches, utf8

#: A-Z become a-z; every other ASCII byte that is neither a digit nor a letter becomes a blank.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

#: Window characters in one automaton; benchmark tables beyond it are scanned in as many passes over the same row.
BLOCK_CHARS = 4_000_000

#: What a scan adds.
RESULT = ["n_words", "n_hit", "item_ids", "spans"]
HITS = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start: long, end: long>>"


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def automaton(patterns: dict[bytes, tuple[int, ...]], lengths: dict[bytes, int]):
    """Values: (words in the pattern, numbers of the items that hold it). Bytes are taken as Latin-1 letters."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for pattern, items in patterns.items():
        made.add_word(f" {pattern.decode('latin-1')} ", (lengths[pattern], items))
    if patterns:
        made.make_automaton()
    return made


def hits(made, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
    """Which words lie in an occurrence, and the numbers of the items that occur."""
    hit, found = np.zeros(len(words) + 1, np.int32), set()
    if not words or not len(made):
        return hit[:-1] > 0, found
    text = f" {b' '.join(words).decode('latin-1')} "
    ends = None
    for at, (n, items) in made.iter(text):
        if ends is None:  # place of the blank behind each word
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        last = int(np.searchsorted(ends, at))
        hit[last - n + 1] += 1
        hit[last + 1] -= 1
        found.update(items)
    return np.cumsum(hit[:-1]) > 0, found


def char_spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as character offsets into the original text, end exclusive."""
    if not hit.any():
        return []
    inside = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    run = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
    return [(int(chars[starts[a]]), int(chars[ends[b]])) for a, b in zip(first, last)]


def _blocks(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded size, read one partition after another, so the driver holds one block at a time."""
    block, chars = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), utf8("text"))
    for item, raw in rows.toLocalIterator():
        words = normal_words(bytes(raw))
        if words:
            block.append((item, words))
            chars += sum(map(len, words)) * window
            if chars >= block_chars:
                yield block
                block, chars = [], 0
    if block:
        yield block


#: The automaton a worker has built last, by block.
_BUILT: dict[str, tuple] = {}


def _built(key: str, shared) -> tuple:
    claim("decontaminate", _BUILT.clear)
    if key not in _BUILT:
        names, patterns, lengths = shared.value
        _BUILT.clear()
        _BUILT[key] = names, automaton(patterns, lengths)
    return _BUILT[key]


def _scanner(key: str, shared, last: bool):
    """A pass over rows (…, __raw, __hit, __items) that adds what one block's automaton finds; the last one reports."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, made = _built(key, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                marks, items, counts, n_hit, spans = [], [], [], [], []
                for raw, old, had in zip(part.column("__raw"), part.column("__hit"), part.column("__items")):
                    raw, old = raw.as_py(), old.as_py()
                    words = normal_words(raw)
                    hit, found = hits(made, words)
                    if old:
                        hit = hit | np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                    items.append(sorted({*had.as_py(), *(names[i] for i in found)}))
                    if last:
                        counts.append(len(words))
                        n_hit.append(int(hit.sum()))
                        spans.append([{"start": a, "end": b} for a, b in char_spans(raw, hit)])
                    else:
                        marks.append(np.packbits(hit).tobytes() if hit.any() else b"")
                kept = [n for n in part.schema.names if not last or n not in ("__raw", "__hit", "__items")]
                own = {"__hit": marks, "__items": pa.array(items, pa.list_(pa.string()))}
                columns = [pa.array(own[n], pa.binary()) if n == "__hit" else own[n] if n == "__items" else part.column(n) for n in kept]
                if last:
                    columns += [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), own["__items"], pa.array(spans, span)]
                    kept += RESULT
                yield pa.RecordBatch.from_arrays(columns, names=kept)

    return scan_rows


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every row of ``docs`` with its word count, hit words, items that occur and hit spans of the original text.

    Columns of ``docs`` named like a result are replaced. Map-only: no row is shuffled. The benchmark is broadcast in
    blocks of about ``block_chars`` window characters; a larger one means more passes within the same stage.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = docs.withColumn("__raw", utf8(text)).drop(*RESULT)
    final = rows.drop("__raw").schema
    for field in T.StructType.fromDDL(HITS).fields:
        final = final.add(field)
    rows = rows.withColumn("__hit", F.lit(b"")).withColumn("__items", F.array().cast("array<string>"))
    schema = rows.schema
    blocks = _blocks(benchmark, window, block_chars)
    block = next(blocks, [])
    while True:
        after = next(blocks, None)
        patterns: dict[bytes, list[int]] = {}
        for number, (_, words) in enumerate(block):
            for pattern in windows_of(words, window):
                patterns.setdefault(pattern, []).append(number)
        shared = sc.broadcast(([i for i, _ in block], {p: tuple(v) for p, v in patterns.items()}, {p: p.count(b" ") + 1 for p in patterns}))
        rows = rows.mapInArrow(_scanner(uuid.uuid4().hex, shared, after is None), final if after is None else schema)
        if after is None:
            return rows
        block = after


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """The documents without any occurrence of a window, columns unchanged."""
    # n_hit under a name of its own, so that a document column called n_hit keeps its values
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text"))
    return scan(bare, benchmark, window=window).where("n_hit = 0").select("__doc.*")


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the contract."""
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

