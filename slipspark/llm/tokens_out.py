"""Token ids as Parquet list columns, laid out for selective reads.

A written set is a folder: ``tokens/`` holds one row per document in order (``part``, ``local_start``, ``n_tokens``, the
id and the list ``ids``), ``parts/`` one small row per file with the tokens and documents before it. Files follow one
another in order. Numbers are delta-coded, ids dictionary- or delta-coded; row groups and pages are small and the page
index is written, so a read of some documents or of the metadata alone touches few pages and never the list column.

Encoding is per run of non-space characters: no token, normal form or special string of the tokenizer crosses ASCII white
space, so each distinct run is encoded by the library once per worker and texts are put together from those results.

Defined results: a null or empty text is the end id alone. Rows without id come first. Equal ids are ordered by their
texts, equal rows stand side by side. An empty table gives an empty set. Columns beyond id and text are not written.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from slipspark.llm.common import claim, partitions, small_batches
from slipspark.session import shared_dir

VOCABULARY = "word_bpe_49k.json"
END_ID = 2

#: ASCII characters that are neither letters, digits nor white space.
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
#: Half the bound of the runs that a worker remembers, and the length up to which it does.
RUNS, LONG = 360_000, 64
#: Bytes of text that are encoded together.
PORTION = 1 << 20

LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",  # delta coding for the number columns
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}


class Encoder:
    """Ids of whole texts, by the tokenizers library on distinct runs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.runs: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # the runs before, until as many new ones have come

    def _encode(self, runs: list[bytes]) -> list[bytes]:
        """Ids of each run. Runs of letters are one piece each, whose last token carries the end-of-word mark, so many of
        them are encoded in one call and parted there."""
        texts = [r.decode() for r in runs]
        words = [i for i, t in enumerate(texts) if t.lower().isalpha()]
        made: dict[int, bytes] = {}
        ids = np.array(self.library.encode(" ".join([texts[i] for i in words]), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1 if len(ids) else []
        if len(ends) == len(words):
            flat, cuts = ids.tobytes(), [0, *(4 * ends).tolist()] if len(words) else [0]
            made = {i: flat[x:y] for i, x, y in zip(words, cuts, cuts[1:])}
        rest = [i for i in range(len(runs)) if i not in made]
        made.update((i, array("I", e.ids).tobytes()) for i, e in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)))
        return [made[i] for i in range(len(runs))]

    def _runs(self, runs: list[bytes]) -> list[bytes]:
        """Ids of distinct runs, from memory where known."""
        known, older = self.runs, self.older
        found = list(map(known.get, runs))
        parts: dict[int, tuple[bytes, bytes]] = {}
        wanted: set[bytes] = set()
        for i in [i for i, ids in enumerate(found) if ids is None]:
            run = runs[i]
            if ids := older.get(run):
                found[i] = known[run] = ids
                continue
            # marks behind a letter are a piece of their own: such runs are put together, not remembered
            stem = run.rstrip(MARKS)
            if len(stem) < len(run) and stem[-1:].isalpha() and b"<|" not in run:
                parts[i] = stem, run[len(stem) :]
                wanted.update(parts[i])
            else:
                parts[i] = run, b""
                wanted.add(run)
        fresh = [r for r in wanted if r not in known and r not in older]
        made = dict(zip(fresh, self._encode(fresh)))
        look = lambda r: made[r] if r in made else known[r] if r in known else older[r]
        for i, (stem, tail) in parts.items():
            found[i] = look(stem) + look(tail) if tail else look(stem)
        known.update((r, ids) for r, ids in made.items() if len(r) <= LONG)
        if len(known) >= RUNS:
            self.older, self.runs = known, {}
        return found

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an array of strings without nulls) in one row, and where each text begins and the last ends."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)  # as the tokenizer does, but for its special strings
        # a comma or full stop between a letter and white space is a piece of its own, so words meet in fewer forms
        texts = pc.replace_substring_regex(texts, r"([A-Za-z])([.,])([\t-\r ])", r"\1 \2\3")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().cast(pa.binary()).dictionary_encode()
        runs = self._runs(coded.dictionary.to_pylist())
        words = coded.indices.to_numpy()
        last = split.value_lengths().to_numpy().cumsum(dtype=np.int64)  # words before the end of each text
        if end is not None:  # a word of its own behind each text
            words = np.insert(words, last, len(runs))
            runs.append(np.array([end], "<u4").tobytes())
            last = last + np.arange(1, len(last) + 1)
        sizes = np.fromiter(map(len, runs), np.int32, len(runs)) >> 2
        bank = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.frombuffer(b"".join(runs), "<u4"))
        taken = bank.take(pa.array(words))
        return taken.flatten().to_numpy(), np.concatenate([[0], taken.offsets.to_numpy()[last]]).astype(np.int64)


def portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of neighbouring rows of about ``most`` bytes together."""
    first = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most or i + 1 == len(sizes):
            yield first, i + 1 - first
            first, held = i + 1, 0


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    claim("tokens_out", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    order: list[str] | None = None,
    vocabulary: str = VOCABULARY,
    vocabulary_file: str | None = None,
    end_id: int | None = END_ID,
    text: str = "text",
) -> None:
    """Encode ``docs`` and write them below ``path`` in the order of ``doc_id`` (or of the ``order`` columns)."""
    spark = docs.sparkSession
    small_batches(spark)
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(order or ["doc_id"])]
    names = [f"k{i}" for i in range(len(keys))]
    rows = docs.select(*keys, F.col("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("raw"))
    # the text's hash behind the order: one id on many rows still spreads over partitions
    rows = rows.withColumn("tie", F.xxhash64("raw"))
    rows = rows.repartitionByRange(partitions(spark), *names, "tie").sortWithinPartitions(*names, "tie", "raw")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "raw")
    id_field = docs.schema["doc_id"]
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("doc_id", id_field.dataType)]
        + list(T.StructType.fromDDL("local_start long, n_tokens long, ids array<int>").fields)
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_file or vocabulary_path(vocabulary))
        start = 0
        for batch in batches:
            for at, size in portions(pc.binary_length(batch.column("raw")).to_pylist(), PORTION):
                part = batch.slice(at, size)
                ids, starts = own.encode(part.column("raw"), end_id)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("part"), part.column("doc_id"), pa.array(start + starts[:-1]), pa.array(np.diff(starts)), lists],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                start += int(starts[-1])

    rows.mapInArrow(encode, schema).write.options(**LAYOUT).parquet(f"{path}/tokens")
    files = spark.read.schema(schema).parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over a row per file
    files = files.select("part", "tokens", "documents", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("tokens", "documents")))
    files.coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens[, ids]); without ``ids`` the list column is not read."""
    rows = spark.read.parquet(f"{path}/tokens")
    parts = F.broadcast(spark.read.parquet(f"{path}/parts").select("part", "tokens_before"))  # a row per file
    rows = rows.join(parts, "part").withColumn("start", F.col("local_start") + F.col("tokens_before"))
    return rows.select("doc_id", "start", "n_tokens", *(["ids"] if ids else []))


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """The documents that hold tokens ``start`` to ``end`` (exclusive) of the stream, ids cut to it: whole files are left
    out by ``parts/``, pages by the index on ``local_start``."""
    parts = spark.read.parquet(f"{path}/parts")
    near = parts.where((F.col("tokens_before") < end) & (F.col("tokens_before") + F.col("tokens") > start)).collect()
    wanted = F.lit(False)
    for p in near:
        local = F.col("local_start")
        wanted |= (F.col("part") == p.part) & (local < end - p.tokens_before) & (local + F.col("n_tokens") > start - p.tokens_before)
    rows = spark.read.parquet(f"{path}/tokens").where(wanted).join(F.broadcast(parts.select("part", "tokens_before")), "part")
    rows = rows.withColumn("start", F.col("local_start") + F.col("tokens_before"))
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    size = F.least(F.lit(end), F.col("start") + F.col("n_tokens")) - F.col("start") - skip
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), size.cast("int")).alias("ids"))


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of a list of ids as little-endian 32-bit numbers."""
    flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
    return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], pa.int64())


def encoded(docs: DataFrame, purpose: str = "token-ids", **settings) -> DataFrame:
    """Written to a fresh folder in the shared place and read back: id, place in the stream, count and crc32 of the ids."""
    path = shared_dir(docs.sparkSession, purpose)
    write_tokens(docs, path, **settings)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))
