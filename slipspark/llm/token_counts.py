"""Exact token counts of every prefix of a text, by dynamic programming over byte-level BPE.

A BPE encoding of a string is the only split into tokens in which every neighbouring pair stays as it is when encoded on
its own. So the last token of every prefix follows from the last tokens of shorter ones: token ``s[i:j]`` ends prefix ``j``
if it can stand behind the last token of prefix ``i``. Its count is that of ``i`` plus one, and one pass over a word gives
the count of all its prefixes, where encoding each of them anew would cost the square of the length.

Texts fall into units (white space and the word behind it) that neither tokens nor prefix effects cross. The counts of a
unit depend on its characters alone, so each distinct unit is computed once per worker. A text stores, for each character,
by how much the count changes there; a running sum answers what any prefix costs and what fits a budget, without encoding.

Defined results: a null or empty text has no characters and 0 tokens. Special strings inside a text are one token each, as
in the library's default; a prefix that ends inside one sees ordinary text there. Repeated rows are counted each for itself.
Other columns are carried along; those named like a result are replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipspark.llm.common import claim, utf8

VOCABULARY = "byte_bpe_50k.json"

# Fixed by the tokenizer's file format: how its pre-tokenizer splits a text.
_SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: White space together with what follows it; a split never depends on anything outside.
_UNIT = regex.compile(r"\s*+(?:(?<! )'(?:[stmd]|re|ve|ll)|\p{L}++|\p{N}++|[^\s\p{L}\p{N}]++)|\s++")

#: The same for texts of ASCII alone.
_UNIT_ASCII = re.compile(r"[\t-\r ]*+(?:(?<! )'(?:[stmd]|re|ve|ll)|[A-Za-z]++|[0-9]++|[^\t-\r A-Za-z0-9]++)|[\t-\r ]++")

#: Bounds of what a worker remembers.
UNITS, PAIRS, LONG = 1_000_000, 1_000_000, 48

RESULT = ["n_bytes", "n_tokens", "prefix_deltas"]


def byte_letters() -> dict[str, int]:
    """The letter by which the file format writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes for the byte-level BPE in a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        self.special_strings = sorted(special)
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.trie: dict = {}  # by byte; -1: the token that ends here
        for token in self.tokens:
            node = self.trie
            for byte in token:
                node = node.setdefault(byte, {})
            node[-1] = token
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.stands: dict[tuple[bytes, bytes], bool] = {}
        self.units: dict[str, bytes] = {}

    def encode(self, raw: bytes) -> list[bytes]:
        """The merge rule itself, for the few bytes of a token pair."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def _stand(self, a: bytes, b: bytes) -> bool:
        """Whether b may stand behind a."""
        if len(self.stands) >= PAIRS:
            self.stands.clear()
        known = self.stands[a, b] = self.encode(a + b) == [a, b]
        return known

    def byte_counts(self, raw: bytes) -> list[int]:
        """Tokens of raw[:n] for n = 0..len(raw), where raw is one piece of the pre-tokenizer."""
        n, trie, stands = len(raw), self.trie, self.stands
        counts, last = [0] * (n + 1), [b""] * (n + 1)
        for i in range(n):
            before, node, count = last[i], trie, counts[i] + 1
            for j in range(i, n):
                node = node.get(raw[j])
                if node is None:
                    break
                token = node.get(-1)
                if token and not last[j + 1]:
                    fits = not i or stands.get((before, token))
                    if fits is None:
                        fits = self._stand(before, token)
                    if fits:
                        counts[j + 1], last[j + 1] = count, token
        return counts

    def _piece(self, piece: str) -> list[int]:
        """Counts of piece[:k], k = 1..len(piece)."""
        raw = piece.encode()
        counts = self.byte_counts(raw)
        if len(raw) == len(piece):
            return counts[1:]
        ends = np.cumsum([len(c.encode()) for c in piece])
        return [counts[e] for e in ends]

    def counts_of_unit(self, unit: str) -> list[int]:
        """Counts of unit[:k], k = 1..len(unit)."""
        if (unit[1:] if unit[0] == " " else unit).isalpha():
            return self._piece(unit)
        pieces = _SPLIT.findall(unit)
        blank = len(unit) - len(unit.lstrip()) if unit[:1].isspace() else 0
        if len(pieces) == 1 and blank <= 1 and unit[0] != "'":
            return self._piece(unit)
        out: list[int] = []
        if blank:
            spaces = regex.match(r"\s*", unit).group()
            blank = len(spaces)
            out = self._piece(spaces) if spaces else []
        if blank == len(unit):
            return out
        done, before = 0, 0
        for piece in pieces:
            if done + len(piece) > blank:
                own = self._piece(piece)
                if piece[0] == "'" and len(piece) > 1 and regex.fullmatch(r"'\p{L}+", piece):  # cut, it is no contraction yet
                    cut = self._piece("'")[-1]
                    own = [cut, *(cut + c for c in self._piece(piece[1:])[:-1]), own[-1]]
                out += [before + c for c in own][max(0, blank - done) :]
            else:
                own = self._piece(piece)
            before += own[-1]
            done += len(piece)
        return out

    def _deltas_of_unit(self, unit: str) -> bytes:
        counts = self.counts_of_unit(unit)
        return array("b", [b - a for a, b in zip([0, *counts], counts)]).tobytes()  # beyond a byte: an error, not a wrap

    def _plain(self, text: str) -> list[bytes]:
        units, out = self.units, []
        for unit in (_UNIT_ASCII if text.isascii() else _UNIT).findall(text):
            known = units.get(unit)
            if known is None:
                known = self._deltas_of_unit(unit)
                if len(unit) <= LONG:
                    if len(units) >= UNITS:
                        units.clear()
                    units[unit] = known
            out.append(known)
        return out

    def deltas(self, text: str) -> bytes:
        """A signed byte per character: by how much the count of the prefix that ends there differs from the one before."""
        if not any(s in text for s in self.special_strings):
            return b"".join(self._plain(text))
        assert self.special
        out: list[bytes] = []
        at = 0
        for hit in self.special.finditer(text):
            out += self._plain(text[at : hit.start()])
            open_unit = _UNIT.findall(text[at : hit.start()])[-1:]  # a prefix that ends in the special string goes on with it
            tail = open_unit[0] if open_unit else ""
            base = sum(array("b", self._deltas_of_unit(tail))) if tail else 0
            seen = [sum(sum(array("b", d)) for d in self._plain(tail + hit.group()[:k])) - base for k in range(1, len(hit.group()))] + [1]
            out.append(array("b", [b - a for a, b in zip([0, *seen], seen)]).tobytes())
            at = hit.end()
        return b"".join(out + self._plain(text[at:]))


def prefix_counts(deltas: bytes) -> np.ndarray:
    """Tokens of text[:n] for n = 0..len(text)."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)])


def longest_prefix(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(deltas) <= budget)[-1])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    claim("token_counts", _COUNTERS.clear)
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, *, vocabulary: str = VOCABULARY, path: str | None = None, text: str = "text") -> DataFrame:
    """Every row with ``n_bytes``, ``n_tokens`` and ``prefix_deltas`` (compressed; see ``answers``). Map-only.

    The tokenizer's file is looked up on the executor: by ``vocabulary`` among the public ones, or at ``path``.
    """
    rows = docs.withColumn("__raw", utf8(text)).drop(*RESULT)
    final = rows.drop("__raw").schema
    for field in T.StructType.fromDDL("n_bytes long, n_tokens long, prefix_deltas binary").fields:
        final = final.add(field)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path or vocabulary_path(vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_bytes, n_tokens, packed = [], [], []
                for raw in part.column("__raw"):
                    raw = raw.as_py()
                    deltas = own.deltas(raw.decode())
                    n_bytes.append(len(raw))
                    n_tokens.append(int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64)))
                    packed.append(zlib.compress(deltas, 1))
                kept = [n for n in part.schema.names if n != "__raw"]
                columns = [part.column(n) for n in kept] + [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *RESULT])

    return rows.mapInArrow(count, final)


def answers(counted: DataFrame, *, prefixes: list[int] = (), budgets: list[int] = ()) -> DataFrame:
    """For each row, tokens of the first n characters (``tokens_at``, texts shorter than n count whole) and characters that
    fit a budget (``chars_within``), from the stored counts alone. Without counts (null) the answers are null."""
    long_list = "array<long>"

    @F.pandas_udf(f"tokens_at {long_list}, chars_within {long_list}")
    def answer(packed):
        import pandas as pd

        made = []
        for raw in packed:
            if raw is None:
                made.append((None, None))
                continue
            deltas = zlib.decompress(raw)
            counts = prefix_counts(deltas)
            made.append(([int(counts[min(n, len(deltas))]) for n in prefixes], [longest_prefix(deltas, b) for b in budgets]))
        return pd.DataFrame(made, columns=["tokens_at", "chars_within"])

    return counted.withColumn("__a", answer("prefix_deltas")).select(*counted.columns, "__a.tokens_at", "__a.chars_within")
