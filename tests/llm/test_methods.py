"""The methods behind the operators: dynamic programming, DivideSkip, Pfair, boosting, filters, bootstrapping, linking."""

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slipspark.llm import language_id, line_dedup, mixing, ngram_join, pii, quality, token_counts, tokens_out, tool_calls
from tests.llm import brute
from tests.llm.conftest import ODD, prose

PIECES = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "don", "1", "23", "!", "é", "日本", "\xa0", "\x1c", "ing", "<|endoftext|>", "<|", "|>", "\U0001f600", "==", "́", "Th", "\x85", ".", ","]


def made_up(count, most, pieces=PIECES, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, most))) for _ in range(count)]


def test_prefix_counts_are_exact_at_every_prefix():
    own, library = token_counts.counter(token_counts.vocabulary_path(token_counts.VOCABULARY)), brute.library("byte_bpe_50k.json")
    for text in made_up(400, 9):
        assert list(token_counts.prefix_counts(own.deltas(text))) == [len(library(text[:i])) for i in range(len(text) + 1)], repr(text)


def test_longest_prefix():
    own, library = token_counts.counter(token_counts.vocabulary_path(token_counts.VOCABULARY)), brute.library("byte_bpe_50k.json")
    text = prose(60, 4)
    for budget in (0, 1, 7, 50, 10**6):
        assert token_counts.longest_prefix(own.deltas(text), budget) == max(i for i in range(len(text) + 1) if len(library(text[:i])) <= budget)


def test_prefix_answers(spark, odd):
    library = brute.library("byte_bpe_50k.json")
    got = token_counts.answers(token_counts.count_tokens(odd), prefixes=[0, 5, 10**9], budgets=[3])
    for row in got.select("text", "tokens_at", "chars_within").collect():
        text = row.text or ""
        assert row.tokens_at == [0, len(library(text[:5])), len(library(text))]
        assert len(library(text[: row.chars_within[0]])) <= 3


def test_long_word_takes_linear_time():
    own = token_counts.counter(token_counts.vocabulary_path(token_counts.VOCABULARY))
    assert len(own.deltas("ab" * 200_000)) == 400_000


def test_encoder_equals_library():
    import pyarrow as pa

    library = brute.library("word_bpe_49k.json")
    own = tokens_out.Encoder(tokens_out.vocabulary_path(tokens_out.VOCABULARY))
    texts = made_up(1500, 9, [*PIECES, "I", "̇", "a.", "b,", "..", "K", "K", "İ", "ΑΣ", "<|startoftext|>"])
    for at in range(0, len(texts), 50):
        ids, starts = own.encode(pa.array(texts[at : at + 50]), None)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [library(t) for t in texts[at : at + 50]]


def test_token_set_reads_parts(spark, odd, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "set")
    tokens_out.write_tokens(odd, path)
    whole = tokens_out.read_tokens(spark, path).orderBy("start").collect()
    stream = [i for r in whole for i in r.ids]
    assert len(stream) == sum(r.n_tokens for r in whole)
    for start, end in ((0, 1), (10, 700), (len(stream) - 5, len(stream)), (0, len(stream)), (5, 5)):
        got = tokens_out.read_range(spark, path, start, end).orderBy("start").collect()
        assert [i for r in got for i in r.ids] == stream[start:end]
    narrow = tokens_out.read_tokens(spark, path, ids=False)
    assert "ids" not in narrow.columns and "ids" not in narrow._jdf.queryExecution().executedPlan().toString()
    for file in (tmp_path / "set" / "tokens").glob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["local_start"].encodings and columns["local_start"].has_offset_index
        assert columns["ids.list.element"].has_column_index is not None


def jaccard_links(sets, query):
    return {i for i, s in enumerate(sets) if len(s & query) * 100 >= 85 * len(s | query)}


def test_divide_skip_finds_all_links():
    rng = random.Random(5)
    base = [rng.sample(range(2000), 60) for _ in range(6)]
    sets = [set(b) for b in base]
    for _ in range(150):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randint(0, 2000))
        sets.append(s)
    sets += [set(range(n)) for n in (1, 2, 5, 6, 7, 12, 13)] + [set()]
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    index = ngram_join.Index(arrays)
    for s, a in zip(sets, arrays):
        assert set(index.search(a)) == (jaccard_links(sets, s) if s else set())


def test_sketches_never_rule_out_what_is_there():
    rng = np.random.default_rng(2)
    for n, m in ((0, 3), (5, 5), (60, 70), (400, 470), (3000, 3500), (127, 129)):
        common = rng.integers(-(2**62), 2**62, min(n, m) * 2 // 3)
        a, b = (np.unique(np.concatenate([common, rng.integers(-(2**62), 2**62, k - len(common))])) for k in (n, m))
        bound = ngram_join.overlap_bound(ngram_join.sketch(a), ngram_join.sketch(b))
        assert bound >= ngram_join.overlap(a, b) and (n < 60 or bound < 1.35 * min(n, m))
    crowded = np.arange(5000) << 20  # all in one cell
    assert ngram_join.overlap_bound(ngram_join.sketch(crowded), ngram_join.sketch(crowded[:4500])) >= 4500
    unlike = [ngram_join.sketch(np.unique(rng.integers(-(2**62), 2**62, 500))) for _ in range(20)]
    assert max(ngram_join.overlap_bound(x, y) for x in unlike for y in unlike if x is not y) < 400


@pytest.mark.parametrize("short_list", [1, 3, 64])
def test_join_of_large_groups(spark, monkeypatch, short_list):
    """Groups of near copies whose lists are long, short and mixed; pairs at the very threshold."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short_list)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 3000)
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(100)] + (passage if group else [])
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(w))
    for k in range(20):
        docs.append(" ".join([f"own{k}_{i}" for i in range(30)] + passage))
    docs += docs[:5] + ["a b c d e f g h i", "a b c d e f g h i j", "a b c d", "a b c", "a b c", "b c d"]
    table = list(enumerate(docs, 1))
    got = ngram_join.join(spark.createDataFrame(table, "doc_id long, text string").repartition(5))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == Counter(brute.join(table))


@pytest.mark.parametrize("short_list", [1, 64])
def test_join_with_the_limits_of_the_pipeline(spark, monkeypatch, short_list):
    """Five words and 0.8: pairs on either side of it, and such that four words and 0.85 would not join."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short_list)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 3000)
    docs = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(100)]
        docs += [" ".join(base + [f"g{group}x{i}" for i in range(n)]) for n in (0, 14, 20, 24, 25, 49 + group)]
    docs += ["a b c d", "a b c d e", "a b c d e f g h", "a b c d e f g h i", "b c d e f g h i", None, ""]
    table = list(enumerate(docs, 1))
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = ngram_join.join(frame, width=5, percent=80)
    want = brute.join(table, 5, 80)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == Counter(want)
    kept = corpus_pipeline.near_duplicates(spark, frame, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c if n else d for d, n, c in want})


def test_near_copies_of_the_pipeline_that_op6_would_keep(spark):
    words = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(1, " ".join(words[:100])), (2, " ".join(words))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [1]
    assert ngram_join.distinct_documents(docs, width=4, percent=85).count() == 2


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(30)] + [(5, 5)]
    got = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for a, b in edges:
        if a != b and label[a] != label[b]:
            old = label[a]
            label = {k: label[b] if v == old else v for k, v in label.items()}
    groups = lambda x: sorted(sorted(k for k in x if x[k] == v) for v in set(x.values()))
    assert groups(got) == groups(label)


def test_line_dedup_over_many_ranges(spark, monkeypatch):
    """One line in most documents, so that its run crosses partitions."""
    monkeypatch.setattr(line_dedup, "partitions", lambda spark: 13)
    rng = random.Random(9)
    lines = ["a very common line"] * 20 + [f"line number {i}" for i in range(40)] + ["short"]
    table = [(rng.randint(1, 150), "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6)))) for _ in range(300)]
    got = line_dedup.digest(line_dedup.dedup_lines(spark.createDataFrame(table, "doc_id long, text string").repartition(7)))
    assert Counter(map(tuple, got.collect())) == Counter(brute.line_dedup(table))


def test_keep_bitmaps_hold_no_text(spark):
    table = spark.createDataFrame([(1, "a common line\nx"), (2, "own line\nA common line"), (3, "nothing")], "doc_id long, text string")
    got = line_dedup.keep_bitmaps(table).collect()
    assert [(r.doc, r.n_lines, line_dedup.keep_bits(r.keep, r.n_lines).tolist()) for r in got] == [(2, 2, [True, False])]


@pytest.mark.parametrize("parts", [[1], [1, 1], [333, 333, 334], [700, 200, 60, 39, 1], [50] * 20, [1] * 37 + [163]])
def test_pfair_deviates_by_less_than_a_block(parts):
    slots, done = sum(parts), [0] * len(parts)
    turns = mixing.period(parts)
    assert Counter(s for s, _ in turns) == Counter(dict(enumerate(parts)))
    for slot, (stream, block) in enumerate(turns):
        assert block == done[stream]
        done[stream] += 1
        for s, p in enumerate(parts):
            assert abs(done[s] * slots - p * (slot + 1)) < slots


def test_parts_of():
    assert mixing.parts_of([1, 1, 1], 10) in ([4, 3, 3],)
    assert sum(mixing.parts_of([1000, 1, 1, 1e-9], 100)) == 100 and min(mixing.parts_of([1000, 1, 1, 1e-9], 100)) == 1


def sources(spark, sizes):
    rows = [(i, f"text {i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3}])
def test_mixture_keeps_rows_and_shares(spark, weights):
    docs = sources(spark, {"a": 700, "b": 200, "c": 90, None: 9, "tiny": 1})
    placed = mixing.schedule(docs, weights=weights, slots=100, block_rows=4)
    got = placed.orderBy("position").collect()
    assert sorted(r.doc.doc_id for r in got) == list(range(1000))
    assert len({r.position for r in got}) == 1000
    blocks = sorted({(r.slot, r.stream, r.block) for r in got})
    target = {r.stream: r.target for r in got}
    assert len({b[0] for b in blocks}) == len(blocks) and abs(sum(target.values()) - 1) < 1e-9
    size = Counter(b[1] for b in blocks)
    done = Counter()
    for slot, stream, block in blocks:
        assert block == done[stream]
        done[stream] += 1
        for s in target:
            if done[s] < size[s]:  # as long as it has blocks left
                assert abs(done[s] - target[s] * (slot + 1)) < 1 + 1e-9


def deviation(blocks, weights, sizes):
    """The most by which (slot, stream) of blocks, in order, differ from the weights while a stream has blocks."""
    done, most = dict.fromkeys(weights, 0), 0
    for slot, stream in sorted(blocks):
        for s in (stream, *weights):
            if done[s] < sizes[s]:
                most = max(most, abs(done[s] - weights[s] * slot))
        done[stream] += 1
    return most


def test_mixture_keeps_to_the_weights_asked_for(spark):
    """A weight between two thousandths, over many ranges."""
    docs = sources(spark, {"a": 100, "b": 39900})
    placed = mixing.schedule(docs, weights={"a": 0.0025, "b": 0.9975}, slots=1000, block_rows=1)
    got = placed.select("slot", "doc.source", "target").collect()
    assert {(r.source, r.target) for r in got} == {("a", 0.0025), ("b", 0.9975)}
    assert deviation([(r.slot, r.source) for r in got], {"a": 0.0025, "b": 0.9975}, {"a": 100, "b": 39900}) < 1 + 1e-6
    assert len({r.slot for r in got}) == 40000


def test_every_source_is_a_stream(spark):
    """More sources than a period has places for; ranges don't show in the result."""
    sizes = {f"s{i:03}": 3 + i % 5 for i in range(700)} | {"big": 3000}
    docs = sources(spark, sizes)
    got = mixing.schedule(docs, slots=300, block_rows=1).select("slot", "doc.source", "target", "doc.doc_id").collect()
    weights = {r.source: r.target for r in got}
    assert len(weights) == 701 and len({r.slot for r in got}) == len(got) == sum(sizes.values())
    assert all(abs(weights[s] / weights["big"] - (n / 3000) ** 0.5) < 1e-9 for s, n in sizes.items())
    assert deviation([(r.slot, r.source) for r in got], weights, sizes) < 1 + 1e-6
    assert sorted(got) == sorted(mixing.schedule(docs, slots=10**6, block_rows=1).select("slot", "doc.source", "target", "doc.doc_id").collect())
    weighted = mixing.schedule(docs, weights=weights, block_rows=1).select("slot", "doc.source", "doc.doc_id").collect()
    assert sorted(weighted) == sorted((r.slot, r.source, r.doc_id) for r in got)


def test_ranges_hand_over_what_waits():
    rng = random.Random(12)
    for n in (1, 2, 7, 60):
        weights = [rng.random() ** 4 + 1e-6 for _ in range(n)]
        made = mixing.Sources(mixing.parts_of(weights, mixing.PARTS), [rng.randint(0, 40) for _ in range(n)])
        last = 10**12
        whole, left = mixing.walk([], made.released(0, last), 0, last)
        assert not left and all(made.parts[s] * slot < (j + 1) * mixing.PARTS and j * mixing.PARTS < made.parts[s] * (slot + 1) for slot, _, s, j in whole)
        cuts = sorted({0, last, *rng.sample(range(1, 200), 30), *rng.sample(range(200, 20000), 20)})
        pending, got = np.zeros(n, bool), []
        for start, end in zip(cuts, cuts[1:]):
            got += mixing.walk(made.waiting(pending, start), made.released(start, end), start, end)[0]
            pending = made.hand_over(pending, start, end, *made.alone(start, end))
        assert got == whole


def test_mixture_odd_rows(odd, none):
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns
    assert Counter((r.doc_id, r.text, r.source) for r in kept.collect()) == Counter((d[0], d[1], d[3]) for d in ODD)
    assert mixing.schedule(none).count() == 0


def test_filters_return_all_languages_that_hold_a_gram():
    members = [(g, l) for l in range(11) for g in range(l * 50, l * 50 + 300)]
    made = language_id.build([f"l{i}" for i in range(11)], members)
    grams = np.arange(0, 900, dtype=np.uint32)
    cells = made.cells(grams)
    masks = made.table[0][cells[0]] & made.table[0][cells[1]]
    missed = [(g, l) for g, l in members if not masks[g] >> l & 1]
    assert not missed and made.table.dtype == np.uint16
    wrong = sum(int(masks[g]) >> l & 1 for l in range(11) for g in range(900) if not l * 50 <= g < l * 50 + 300)
    assert wrong / (11 * 600) < 0.02


def test_language_accuracy_on_held_out_rows(spark):
    words = {"xx": "blau grün stein wasser licht haus", "yy": "rouge vert pierre eau lumière maison", "zz": "red green stone water light house"}
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randint(3, 30))), k) for i in range(600) for k in [rng.choice(list(words))]]
    docs = spark.createDataFrame(rows + [(1000, None, "xx"), (1001, "12 34 !", "yy"), (1002, "rot", None)], "doc_id long, text string, lang string")
    filters = language_id.fit(docs.where(~language_id.held_out()))
    got = language_id.identify(docs, filters).withColumn("held_out", language_id.held_out()).collect()
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001)} == {"und"} and all(0 <= r.score <= 1 for r in got)


def test_any_number_of_languages(spark):
    rng = random.Random(14)
    rows = []
    for k in range(300):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [(" ".join(rng.choice(words) for _ in range(12)), f"l{k:03}") for _ in range(4)]
    filters = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(filters.languages) == 300
    assert sum(filters.predict(t.encode())[0] == lang for t, lang in rows) > 0.98 * len(rows)


def test_copies_of_a_text_teach_once(spark):
    """Most rows of a language are copies of one text, or empty; the other texts still teach their n-grams."""
    rng = random.Random(13)
    words = "blau grün stein wasser licht haus baum feuer".split()
    others = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(10)]
    texts = ["quix zorp vlem jask"] * 1390 + [None] * 300 + others
    filters = language_id.fit(spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string"))
    assert min(filters.predict(t.encode())[2] for t in others) >= language_id.LEAST_CONTAINED


def test_language_odd_rows(spark, odd, none):
    filters = language_id.fit(odd)
    got = language_id.identify(odd, filters).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.text in (None, "") or not any(c.isalpha() for c in r.text)} == {"und"}
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit(none)).collect()} == {"und"}
    kept = language_id.in_language(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0
    assert language_id.in_language(none).count() == 0


def test_trees_are_monotonic_and_flat_scores_equal_a_walk():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + 0.5 * np.sin(3 * x[:, 0]) - 0.7 * x[:, 1] + rng.normal(size=3000) > 0).astype(float)
    trees = quality.fit(x[:2000], y[:2000], [1, -1, 0], trees=30)
    held = trees.score(x[2000:])
    assert ((held > 0.5) == (y[2000:] > 0.5)).mean() > 0.75

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(held[:50], [walk(r) for r in x[2000:2050]])
    line = np.linspace(-3, 3, 60)
    for f, sign in ((0, 1), (1, -1)):
        for row in x[:20]:
            many = np.tile(row, (60, 1))
            many[:, f] = line
            assert (sign * np.diff(trees.score(many)) >= -1e-12).all()


def contextual(spark):
    """Accounts behind a phrase that mail addresses teach; the same tokens behind other phrases teach nothing."""
    texts = [f"note {i} please reach account holder user{i}@mail.example.org today" for i in range(12)]
    texts += ["we reach account holder AB-99317 now", "the account holder QX77123 left", "some random token ZZ12345 here", "version number 12345.6 of it"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bootstrapping_finds_unseen_identifiers_in_learned_contexts(spark):
    got = pii.find_pii(contextual(spark)).select("doc_id", "spans").collect()
    added = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind.startswith("context_")] for r in got}
    assert added[12] == [("context_email", 24, 32)] and added[13] == [("context_email", 19, 26)]
    assert not any(added[i] for i in added if i not in (12, 13))
    assert all(len(r.spans) == 1 for r in got if r.doc_id < 12)


def test_pattern_scores(spark):
    edges = [("p", f"i{k}", "email") for k in range(6)] + [("p", "new", None), ("q", "new", None), ("q", "j", "ip"), ("r", "k", None)]
    table = spark.createDataFrame([(*e, 1) for e in edges], "pattern string, instance string, kind string, n long")
    one = {r.pattern: r for r in pii.score_patterns(table, rounds=1).collect()}
    assert one["p"].kind == "email" and abs(one["p"].score - 6 / 8) < 1e-9 and one["p"].n_seeds == 6
    two = {r.pattern: r for r in pii.score_patterns(table, rounds=2).collect()}
    assert abs(two["p"].score - (6 + 6 / 8) / 8) < 1e-9 and "r" not in two


def test_pii_rules_on_made_up_texts(spark):
    pieces = ["a", "b.c", "@", "x@y.zz", "@@", "..", ".", "-", "1", "12", "255", "256", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", "+1 (2", "+", "555-01", ") ", " ", "\n", "é", "\U0001f600", "%", "_"]
    table = list(enumerate(made_up(800, 14, pieces, 12)))
    got = pii.digest(pii.find_pii(spark.createDataFrame(table, "doc_id long, text string")))
    assert Counter(map(tuple, got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect())) == Counter(brute.pii(table))


def test_pii_long_runs(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "a@b" + ".c" * 50_000, "+1" + " " * 200_000, "x@y.z " * 3000]
    got = pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {r.doc_id: r.n_email for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 3000}


def plain_link(calls, results, schemas):
    """(conv, call id, status, level, results, errors) by one walk per conversation."""
    out = Counter()
    by_id, extra = {}, Counter()
    for c in sorted(calls, key=lambda c: (c[1] is None, c[1] or 0, c[3] or "", str(c[4]))):
        if c[2] is None or c[0] is None:
            out[(c[0], c[2], "no_id", -1, 0)] += 1
        elif (c[0], c[2]) in by_id:
            extra[(c[0], c[2])] += 1
        else:
            by_id[c[0], c[2]] = c
    answers = defaultdict(int)
    for r in results:
        if r[2] is None or r[0] is None or (r[0], r[2]) not in by_id:
            if r[2] is None or r[0] is None:
                out[(r[0], r[2], "orphan", -1, 1)] += 1
                continue
        answers[r[0], r[2]] += 1
    refs = {k: {(k[0], x) for x in tool_calls.references(tool_calls.parsed(c[4])[0])} & by_id.keys() for k, c in by_id.items()}
    level = {}
    while fresh := {k for k in by_id if k not in level and all(r in level for r in refs[k])}:
        level |= {k: max((level[r] + 1 for r in refs[k]), default=0) for k in fresh}
    for k in by_id:
        status = "cycle" if k not in level else "linked" if answers.get(k) else "open"
        out[(*k, status, level.get(k, -1), answers.get(k, 0))] += 1
    for k, n in extra.items():
        out[(*k, "duplicate", -1, 0)] += n
    for k, n in answers.items():
        if k not in by_id:
            out[(*k, "orphan", -1, n)] += 1
    return out


CALLS = [
    (1, 1, "a", "search", '{"query": "x", "limit": 3}'),
    (1, 3, "b", "search", '{"limit": 99, "query": {"$ref": "a"}}'),
    (1, 5, "c", "measure", '{"unit": "words", "text": [{"$ref": "b"}, {"$ref": "a"}]}'),
    (1, 7, "c", "measure", '{"unit": "words"}'),
    (1, 7, "c", "measure", '{"unit": "words"}'),
    (2, 1, "x", "search", '{"query": {"$ref": "y"}}'),
    (2, 1, "y", "search", '{"query": {"$ref": "x"}}'),
    (2, 3, "z", "search", '{"query": {"$ref": "y"}, "odd": 1}'),
    (2, 5, "lost", "search", '{"query": {"$ref": "nowhere"}}'),
    (2, 7, "bad", "search", "{"),
    (2, 9, "list", "search", "[1]"),
    (3, None, "n", None, None),
    (3, 1, None, "search", '{"query": "q"}'),
    (None, 1, "a", "search", '{"query": "q"}'),
    (4, 1, "u", "teleport", '{"é": 1.50, "a": null, "B": true}'),
]
RESULTS = [(1, 2, "a", "r1"), (1, 4, "a", "r2"), (1, 4, "b", None), (1, 2, "c", "early"), (2, 9, "nobody", "o"), (3, 2, None, "lonely"), (None, 2, "a", "x"), (4, 2, "u", "é\n\"")]
CALL, RESULT = "conv_id long, turn long, call_id string, name string, arguments string", "conv_id long, turn long, call_id string, content string"


def test_tool_calls(spark):
    got = tool_calls.link(spark.createDataFrame(CALLS, CALL), spark.createDataFrame(RESULTS, RESULT), tool_calls.SCHEMAS).collect()
    assert Counter((r.conv_id, r.call_id, r.status, r.level, r.n_results) for r in got) == plain_link(CALLS, RESULTS, tool_calls.SCHEMAS)
    first = {(r.conv_id, r.call_id): r for r in got if r.status not in ("duplicate", "no_id")}
    assert first[1, "a"].content == "r1" and not first[1, "a"].errors and first[1, "c"].early
    assert first[1, "b"].errors == ["$.limit: above maximum"] and first[2, "z"].errors == ["$.odd: not known"]
    assert first[2, "lost"].errors == ["unknown reference nowhere"] and first[2, "list"].errors == ["$: no object"]
    assert first[4, "u"].line == '{"arguments":{"B":true,"a":null,"é":1.5},"errors":["unknown tool"],"id":"u","name":"teleport","result":"é\\n\\"","status":"linked"}'


def test_tool_calls_empty(spark):
    calls, results = spark.createDataFrame([], CALL), spark.createDataFrame([], RESULT)
    assert tool_calls.link(calls, results, {}).count() == 0


def test_tool_calls_from_conversations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", prose(12, c * 10 + t) + ' "quoted"') for c in range(60) for t in range(8)] + [(None, None, None, None), (70, 1, "assistant", None)]
    calls, results = tool_calls.from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = tool_calls.link(calls, results, tool_calls.SCHEMAS).collect()
    assert Counter((r.conv_id, r.call_id, r.status, r.level, r.n_results) for r in got) == plain_link(calls.select("conv_id", "turn", "call_id", "name", "arguments").collect(), results.collect(), tool_calls.SCHEMAS)
    assert {"linked", "open", "duplicate", "no_id"} <= {r.status for r in got} and max(r.level for r in got) >= 2
    assert all(r.line == tool_calls.canonical(json.loads(r.line)) for r in got)


def _shuffled(spark):
    """Bytes that the stages of the session have shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    executors = sc._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_texts_tied_by_passages_do_not_move_times_each_other(spark, monkeypatch):
    """Every text shares passages with many others, so all are tied together, but only the planted pairs are alike."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 3000)
    rng = random.Random(3)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(1200)]
    texts = [" ".join(rng.sample(passages, 50)) for _ in range(150)]
    texts += [t.rsplit(" ", 12)[0] + f" other{i} end" for i, t in enumerate(texts[:10])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    frame.count()
    before = _shuffled(spark)
    got = {r.doc_id: r.component_id for r in ngram_join.join(frame).collect()}
    moved = _shuffled(spark) - before
    assert moved < 12_000_000, moved  # sets of all texts against all took 24 MB
    assert got == {i: i - 150 if i >= 150 else i for i in range(160)}
