"""Language ID with bit-sliced Bloom filters over byte n-grams.

One table serves all languages: cell ``p`` is a word whose bit ``l`` is cell ``p`` of language ``l``'s Bloom filter. Reading
the cells of an n-gram's hash positions and and-ing them gives every language that may contain the n-gram at once. Over a
text, the bits are counted per language, the share of hits that the filter's fill would give by chance is taken out, and the
language that contains most of the text wins.

An n-gram belongs to a language if at least ``min_share`` of its sampled texts (two at least, if there are as many as two)
hold it. The filters are fitted on a sample of about ``sample`` different labelled texts per language, drawn by hash; copies
of a text and empty texts add nothing. Counts of languages and predictions cover all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Without labelled rows everything is ``und``.
Ties go to the language with more labelled documents, then to the smaller name. Repeated rows get the same answer; other
columns are carried along, those named like a result are replaced. Language, source and id never enter a prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipspark.llm.common import claim, small_batches, utf8

GRAM = 4
#: Different labelled texts per language in the fitting sample (expected number). Up to so many languages, filters are sized by
#: all n-grams; beyond, by those of the largest language, so that the table grows in proportion to the languages.
SAMPLE, LANGUAGES = 1500, 256
MIN_SHARE = 0.01
#: Steps in which a sample's share is held.
DRAWS = 1 << 40
HASHES = 2
UND = "und"

# ASCII letters lower-cased, other ASCII a blank, the rest (letters of other scripts, accents) kept.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def grams(raw: bytes) -> np.ndarray:
    """All n-grams of the normal form, as numbers; words are parted and framed by single blanks."""
    a = np.frombuffer(b"  " + b" ".join(raw.translate(_NORMAL).split()) + b"  ", np.uint8).astype(np.uint32)
    return a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # (words, cells) of bit-sliced filters
    chance: np.ndarray  # false-positive rate of each language's filter

    @property
    def width(self) -> int:
        return self.table.dtype.itemsize * 8

    def cells(self, g: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - int(self.table.shape[1]).bit_length() + 1)
        wide = g.astype(np.uint64)
        return [(wide * f) >> shift for f in _FACTORS[:HASHES]]

    def shares(self, raw: bytes) -> np.ndarray:
        """For each language, the share of the text's n-grams that it contains, chance hits taken out."""
        g = grams(raw)
        cells = self.cells(g)
        counts = np.zeros(len(self.languages))
        for word in range(self.table.shape[0]):
            found = self.table[word][cells[0]]
            for c in cells[1:]:
                found &= self.table[word][c]
            own = range(word * self.width, min(len(counts), (word + 1) * self.width))
            if self.width == 8:
                by_mask = np.bincount(found, minlength=256)
                for i in own:
                    counts[i] = by_mask[(np.arange(256) >> (i - word * 8)) & 1 == 1].sum()
            else:
                for i in own:
                    counts[i] = np.count_nonzero(found & self.table.dtype.type(1 << (i - word * self.width)))
        return np.clip((counts / len(g) - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)

    def predict(self, raw: bytes) -> tuple[str, float, float]:
        """Language, its share among all languages' shares, and how much of the text it contains."""
        if not self.languages or not has_letter(raw.decode()):
            return UND, 0.0, 0.0
        share = self.shares(raw)
        best = int(np.argmax(share))
        total = float(share.sum())
        return self.languages[best], float(share[best]) / total if total else 1 / len(share), float(share[best])


def build(languages: list[str], members: list[tuple[int, int]]) -> Filters:
    """Filters from (n-gram, number of a language that contains it)."""
    many = len(languages) > LANGUAGES
    held = max(Counter(l for _, l in members).values(), default=0) if many else len({g for g, _ in members})
    cells = 1 << max(12, (16 * held).bit_length())
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.dtype(k).itemsize * 8), np.uint64)
    width = np.dtype(kind).itemsize * 8
    made = Filters(languages, np.zeros((max(1, -(-len(languages) // width)), cells), kind), np.zeros(len(languages)))
    if members:
        g, language = np.array(members, np.int64).T
        for at in range(len(languages)):
            for c in made.cells(g[language == at].astype(np.uint32)):
                made.table[at // width][c] |= kind(1 << at % width)
            fill = np.count_nonzero(made.table[at // width] & kind(1 << at % width)) / cells
            made.chance[at] = fill**HASHES
    return made


def fit(labelled: DataFrame, *, sample: int = SAMPLE, min_share: float = MIN_SHARE, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from rows with text and a non-null language."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), utf8(text).alias("raw"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in counts]
    if not languages:
        return build([], [])
    # copies share a hash, so texts are counted and drawn by it before any text is moved
    hashed = rows.where(F.length("raw") > 0).withColumn("h", F.xxhash64("raw", "lang"))
    texts = {r["lang"]: r["n"] for r in hashed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    shares = [(name, int(min(1.0, sample / texts[name]) * DRAWS)) for name in languages if name in texts]
    drawn = labelled.sparkSession.createDataFrame(shares, "lang string, below long")
    chosen = hashed.join(F.broadcast(drawn), "lang").where(F.pmod("h", F.lit(DRAWS)) < F.col("below")).select("lang", "raw").distinct()
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id", lambda: None)
        docs = np.zeros(len(languages), np.int64)
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the partition so far
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang_no = [number[x] for x in part.column("lang").to_pylist()]
                docs += np.bincount(lang_no, minlength=len(languages))
                grams_of = [np.unique(grams(raw.as_py())).astype(np.int64) | n << 32 for n, raw in zip(lang_no, part.column("raw"))]
                fresh, times = np.unique(np.concatenate(grams_of), return_counts=True)
                key, place = np.unique(np.concatenate([key, fresh]), return_inverse=True)
                n = np.bincount(place, np.concatenate([n, times]), minlength=len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([key, -1 - np.arange(len(languages))])), pa.array(np.concatenate([n, docs]))], names=["key", "n"]
        )

    totals = chosen.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    sampled = {-1 - r.key: r.n for r in totals.where("key < 0").collect()}
    least = [(i, max(min(2, sampled.get(i, 0)), int(np.ceil(min_share * sampled.get(i, 0))))) for i in range(len(languages))]
    least = labelled.sparkSession.createDataFrame(least, "number long, least long")
    # a document adds each of its n-grams once, so at most 1 / min_share times the mean number per document pass
    kept = totals.where("key >= 0").withColumn("number", F.shiftright("key", 32)).join(F.broadcast(least), "number").where("n >= least").select("key").toPandas()["key"].to_numpy(np.int64)
    return build(languages, list(zip((kept & 0xFFFFFFFF).tolist(), (kept >> 32).tolist())))


RESULT = ["lang_pred", "score", "contained"]


def identify(docs: DataFrame, filters: Filters, *, text: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``score`` and ``contained`` (share of the text's n-grams that the language has)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # a bit per language and cell over the fitted n-grams
    rows = docs.withColumn("__raw", utf8(text)).drop(*RESULT)
    final = rows.drop("__raw").schema
    for field in T.StructType.fromDDL("lang_pred string, score double, contained double").fields:
        final = final.add(field)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id", lambda: None)
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                said = [own.predict(raw.as_py()) for raw in part.column("__raw")]
                names = [n for n in part.schema.names if n != "__raw"]
                columns = [part.column(n) for n in names] + [pa.array([s[i] for s in said], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *RESULT])

    return rows.mapInArrow(predict, final)


def held_out() -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Less of a text in its best language than this: it is in none of the learned ones.
LEAST_CONTAINED = 0.5


def in_language(docs: DataFrame, *, least_contained: float = LEAST_CONTAINED) -> DataFrame:
    """The documents in a learned language, columns unchanged; rejected are ``und`` ones and those that no language contains."""
    filters = fit(docs.where(~held_out()))
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text"))
    return identify(bare, filters).where((F.col("lang_pred") != UND) & (F.col("contained") >= least_contained)).select("__doc.*")
