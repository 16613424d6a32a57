import re
from collections import Counter

from pyspark.sql import functions as F

from slipspark.llm import collocations
from tests.llm.conftest import SCHEMA, prose


def brute(docs, least, top):
    f, total = {}, Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            if any(len(g) == 2 and b[i : i + 2] == g and 100 * n >= 50 * a for b, n in found.items() if len(b) == 3 for i in (0, 1)):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def mined(frame, **limits):
    got = collocations.collocations(frame, **limits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(collocations, "WRITE_ROWS", 100)
    texts = [("en" if i % 3 else "fr", prose(200, i % 7) + ". New York, new YORK city! a a a a\tb\x0bc d" + "\x00 x" * (i % 2)) for i in range(40)]
    texts += [(None, "new york city"), (None, None), ("en", ""), ("de", " ,;. "), ("und", "new york city new york city"), ("a\nb", "new york city"), ("", "new york city")]
    frame = spark.createDataFrame([(i, t, lang, "s") for i, (lang, t) in enumerate(texts)], SCHEMA).repartition(3)
    for least, top in ((2, 50), (3, 100_000)):
        assert mined(frame, least=least, top=top) == brute(texts, least, top)


def test_odd_rows(odd, none):
    docs = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert mined(odd, least=2, top=300) == brute(docs, 2, 300)
    assert mined(none) == []


def test_lockstep_over_borders(spark, monkeypatch):
    """Heads and their tails in small Arrow batches: what is carried crosses them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        heads = spark.range(50).select(F.lit("en").alias("lang"), F.col("id").cast("string").alias("k"), F.col("id").cast("string").alias("phrase"), (F.col("id") + 1000).alias("f"), F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("longest"))
        tails = spark.range(500).select(F.lit("en").alias("lang"), (F.col("id") % 40).cast("string").alias("k"), F.concat(F.lit("t"), "id").alias("phrase"), F.col("id").alias("f"), F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("longest"))
        got = collocations.lockstep(heads, tails, ["lang", "k"], {"own": "f"}, "longest").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 550
    for r in got:
        if r.phrase.startswith("t"):
            assert r.own == int(r.k) + 1000
        else:
            assert r.longest == (max(x for x in range(500) if x % 40 == int(r.k)) if int(r.k) < 40 else 0)
