"""Phrase collocation mining by external stream estimation: counts are sorted streams, joined by walking them in lockstep.

One pass over the texts counts words, pairs and triples. A block of text is counted at once, and its counts leave the task as compressed
runs, one for each slot that phrases are dealt to; who receives a slot sums its runs, one slot after another. What
reaches the least count is kept as a stream of counts. A stream in *prefix* order has a phrase's continuations right
behind the phrase, one in *suffix* order has what ends in a phrase right behind it. Two streams are merged by one walk that
carries the last shorter phrase forward (left and right counts) and looks one row ahead (the greatest extension, as the longer
ones come by falling count). Nothing is looked up in a hash table.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they are there;
ties in score go to the greater count, then to the smaller phrase in byte order; an empty table gives an empty result; further
columns of ``docs`` are not read. A text of any length is counted whole, by one task. Counts must stay below 10^16, so that
the products of the score fit 38 digits.

After the counting, the rows of one shorter phrase are its frequent continuations, a row each: a hot word is as long a run as
it has different neighbours. A run is streamed, never held.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipspark.llm.common import partitions, small_batches, utf8, written

#: Bytes of text counted at once, phrases written out together, and slots that a partition of counts is summed in.
BLOCK_BYTES, WRITE_ROWS, SLOTS = 8_000_000, 500_000, 4
#: Language of documents that have none.
NO_LANGUAGE = "und"

_BREAKS, _BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)] = 1
_KIND[list(_BREAKS)] = 2
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _tokens(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """Words of the texts, each of which ends in a break, and the number of the piece that each word is in."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    kind = _KIND[data]
    word = kind == 0
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    flat = _LOWER[data[word]]
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(flat)]), piece


@dataclass
class _Counts:
    """Counted phrases of one language in a block: a word number from each of ``parts`` for each phrase."""

    lang: str
    names: pa.Array
    parts: list[np.ndarray]
    hashes: np.ndarray
    counts: np.ndarray

    def keys(self, rows: np.ndarray) -> pa.Array:
        """Language and phrase; a phrase holds no line break."""
        words = [self.names.take(pa.array(p[rows])) for p in self.parts]
        phrases = pc.binary_join_element_wise(*words, " ") if len(words) > 1 else words[0]
        return pc.binary_join_element_wise(pa.scalar(self.lang), phrases, "\n")


def _counted(lang: str, texts: pa.Array, most_words: int) -> Iterator[_Counts]:
    """Counts of all phrases of 1 to ``most_words`` words; the empty phrase counts all words."""
    tokens, piece = _tokens(texts)
    if not len(tokens):
        return
    own = np.uint64(zlib.crc32(lang.encode()))
    yield _Counts(lang, pa.array([""]), [np.zeros(1, np.int32)], np.array([own]), np.array([len(tokens)]))
    coded = tokens.dictionary_encode()
    ids, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    words = pd.util.hash_array(np.array(names.to_pylist(), object), categorize=False) ^ own
    # a phrase of k words is a number for its first k-1 words, and its last word; both are below 2^31
    begun, where, parts, hashes = ids, np.arange(len(ids)), [np.arange(len(names), dtype=np.int32)], words
    yield _Counts(lang, names, parts, hashes, np.bincount(ids, minlength=len(names)))
    for k in range(2, most_words + 1):
        fits = (where + k - 1 < len(ids)) & (piece[np.minimum(where + k - 1, len(ids) - 1)] == piece[where])
        where, begun = where[fits], begun[fits]
        if not len(where):
            return
        keys, begun, counts = np.unique(begun * len(names) + ids[where + k - 1], return_inverse=True, return_counts=True)
        first, last = (x.astype(np.int32) for x in (keys // len(names), keys % len(names)))
        parts = [p[first] for p in parts] + [last]
        hashes = hashes[first] * np.uint64(0x9E3779B97F4A7C15) + words[last]
        yield _Counts(lang, names, parts, hashes, counts)


_RUN = "slot int, n int, lengths binary, keys binary, counts binary"


def _runs(counted: list[_Counts], slots: int) -> Iterator[pa.RecordBatch]:
    """All counts of a block, a compressed run for each slot, or several of a very large block."""
    dealt = [((c.hashes >> np.uint64(20)) % np.uint64(slots)).astype(np.int32) for c in counted]
    sizes = np.bincount(np.concatenate(dealt), minlength=slots) if dealt else np.zeros(slots, np.int64)
    orders = [np.argsort(d, kind="stable") for d in dealt]
    ends = [np.searchsorted(d[o], np.arange(slots + 1)) for d, o in zip(dealt, orders)]
    pressed = lambda raw: pa.compress(raw, codec="zstd", asbytes=True)
    at = 0
    while at < slots:  # so many slots at once that their keys fit an Arrow array
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), WRITE_ROWS, "right")))
        parts = [(c, o[e[at] : e[to]], d) for c, o, e, d in zip(counted, orders, ends, dealt)]
        keys = pa.concat_arrays([c.keys(rows) for c, rows, _ in parts])
        slot = np.concatenate([d[rows] for _, rows, d in parts])
        order = np.argsort(slot, kind="stable")
        keys, slot = keys.take(pa.array(order)), slot[order]
        n = np.concatenate([c.counts[rows] for c, rows, _ in parts])[order].astype("<i8")
        ends_of = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
        data, lengths = memoryview(keys.buffers()[2] or b""), np.diff(ends_of).astype("<i4")
        cuts = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot))
        rows = [(slot[a], b - a, pressed(lengths[a:b].tobytes()), pressed(bytes(data[ends_of[a] : ends_of[b]])), pressed(n[a:b].tobytes())) for a, b in zip(cuts, cuts[1:])]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["slot", "n", "lengths", "keys", "counts"])
        at = to


def _opened(run: dict) -> pa.Table:
    lengths = np.frombuffer(pa.decompress(run["lengths"], 4 * run["n"], codec="zstd"), "<i4")
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    data = pa.py_buffer(pa.decompress(run["keys"], int(ends[-1]), codec="zstd"))
    counts = np.frombuffer(pa.decompress(run["counts"], 8 * run["n"], codec="zstd"), "<i8")
    return pa.table({"key": pa.Array.from_buffers(pa.string(), run["n"], [None, pa.py_buffer(ends), data]), "f": counts})


def phrase_counts(docs: DataFrame, most_words: int, least: int) -> DataFrame:
    """lang, phrase, f of all phrases that occur ``least`` times or more; the empty phrase has the number of words."""
    spark = docs.sparkSession
    small_batches(spark)
    slots = partitions(spark) * SLOTS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(block)
            lang, text = table["lang"].combine_chunks(), table["text"].combine_chunks()
            codes = lang.dictionary_encode()
            which = codes.indices.to_numpy()
            texts = [text.take(pa.array(np.flatnonzero(which == code))) for code in range(len(codes.dictionary))]
            yield from _runs([c for name, own in zip(codes.dictionary.to_pylist(), texts) for c in _counted(name, own, most_words)], slots)

        block, size = [], 0
        for batch in batches:
            block.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield from flush(block)
                block, size = [], 0
        if block:
            yield from flush(block)

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(runs: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            f = pa.concat_tables(runs).combine_chunks().group_by("key", use_threads=False).aggregate([("f", "sum")])
            f = f.filter(pc.greater_equal(f["f_sum"], least)).select(["key", "f_sum"]).rename_columns(["key", "f"])
            yield from f.combine_chunks().to_batches(50_000)

        slot, runs = None, []
        for batch in batches:
            for run in batch.to_pylist():
                if run["slot"] != slot:
                    if runs:
                        yield from summed(runs)
                    slot, runs = run["slot"], []
                runs.append(_opened(run))
        if runs:
            yield from summed(runs)

    ended = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.concat(utf8("text"), F.lit("\n").cast("binary")).alias("text"))
    runs = ended.mapInArrow(count, _RUN).repartition(partitions(spark), "slot").sortWithinPartitions("slot")
    lang, phrase = F.regexp_extract("key", r"(?s)^(.*)\n", 1), F.substring_index("key", "\n", -1)
    return runs.mapInArrow(total, "key string, f long").select(lang.alias("lang"), phrase.alias("phrase"), "f")


def lockstep(heads: DataFrame, tails: DataFrame, keys: list[str], take: dict[str, str], longest: str) -> DataFrame:
    """Both streams in the order of ``keys``, walked together: each tail gets the columns ``take`` (own name: the head's) of the
    head of its key, each head gets the greatest ``f`` of its tails as ``longest``, 0 without any.

    Every key has one head at most, and a head for each of its tails. Both frames have the same columns, all numbers but
    keys and phrase."""
    schema = heads.withColumn("tail", F.lit(0)).withColumns({c: F.lit(0).cast("long") for c in [*take, longest]}).schema
    both = heads.withColumn("tail", F.lit(0)).unionByName(tails.withColumn("tail", F.lit(1)))
    both = both.withColumns({c: F.lit(0).cast("long") for c in [*take, longest] if c not in heads.columns}).select(schema.names)
    order = [*keys, "tail", F.desc("f"), "phrase"]
    stream = both.repartitionByRange(partitions(heads.sparkSession), *keys).sortWithinPartitions(*order)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = dict.fromkeys(take, 0)

        def done(rows: pa.Table, following: int) -> pa.Table:
            """All rows with their columns; ``following`` is the count of the tail behind the last row, or 0."""
            tail = rows["tail"].to_numpy() == 1
            at = np.maximum.accumulate(np.where(tail, -1, np.arange(len(tail)))) + 1
            f = rows["f"].to_numpy()
            behind = np.append(np.where(tail[1:], f[1:], 0), following)
            own = rows[longest].to_numpy()
            new = {longest: np.where(tail, own, behind)}
            for name, source in take.items():
                of_head = np.concatenate([[carried[name]], rows[source].to_numpy()])[at]
                new[name] = np.where(tail, of_head, rows[name].to_numpy())
                carried[name] = int(of_head[-1])
            for name, values in new.items():
                rows = rows.set_column(rows.column_names.index(name), name, pa.array(values, pa.int64()))
            return rows

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                first = batch.slice(0, 1).to_pydict()
                yield from done(held, first["f"][0] if first["tail"][0] else 0).to_batches()
            held = pa.Table.from_batches([batch])
        if held is not None:
            yield from done(held, 0).to_batches()

    return written(stream.mapInArrow(walk, schema), "collocation-stream").drop("tail")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text. The score of a cut is floor(10^6 a^2 / (l r)), the lowest one counts, of equal ones the first.
    A phrase that half of the time or more is part of one longer candidate is left out."""
    counts = written(phrase_counts(docs, 3, least), "collocation-counts")
    word = F.split("phrase", " ")
    counts = counts.withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(F.size(word)))
    counts = counts.withColumns({f"w{i + 1}": F.coalesce(F.get(word, F.lit(i)), F.lit("")) for i in range(3)})
    numbers = {c: F.lit(0).cast("long") for c in ("l1", "r1", "l2", "r2", "left_ext", "right_ext")}
    plain = counts.withColumns(numbers)
    of = {k: plain.where(F.col("words") == k) for k in (1, 2, 3)}

    def keyed(frame: DataFrame, a: str, b: str = "") -> DataFrame:
        return frame.withColumns({"k1": F.col(a), "k2": F.col(b) if b else F.lit("")})

    keys = ["lang", "k1", "k2"]

    def only(frame: DataFrame, k: int) -> DataFrame:
        return frame.where(F.col("words") == k).drop("k1", "k2")

    # l1 and r1 are the counts left and right of the cut behind the first word, l2 and r2 behind the second
    pairs = only(lockstep(keyed(of[1], "w1"), keyed(of[2], "w1"), keys, {"l1": "f"}, "right_ext"), 2)
    pairs = only(lockstep(keyed(of[1], "w1"), keyed(pairs, "w2"), keys, {"r1": "f"}, "left_ext"), 2)
    both = lockstep(keyed(pairs, "w1", "w2"), keyed(of[3], "w1", "w2"), keys, {"l1": "l1", "l2": "f"}, "right_ext")
    both = lockstep(keyed(only(both, 2), "w1", "w2"), keyed(only(both, 3), "w2", "w3"), keys, {"r2": "r1", "r1": "f"}, "left_ext")

    a = F.col("f").cast("decimal(38,0)")

    def score(left: str, right: str) -> F.Column:
        return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(38,0)"), F.col(left).cast("decimal(38,0)") * F.col(right).cast("decimal(38,0)"))

    cut = F.struct(score("l1", "r1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r"))
    later = F.struct(score("l2", "r2").alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r2").alias("r"))
    free = both.where(100 * F.greatest("left_ext", "right_ext") < 50 * F.col("f"))
    scored = free.withColumn("cut", F.when(F.col("words") == 2, cut).otherwise(F.least(cut, later)))
    scored = scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    words = counts.where(F.col("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= top).join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
