"""The scored graph of patterns and instances against plain Python, and what it finds."""

import math
import random
from collections import defaultdict

from slipspark.llm import pii
from tests.llm import brute


def plain_scores(edges, rounds, least_seeds):
    """pattern: {kind: (score, seeds)} by the words of the method."""
    size, scores, patterns = defaultdict(int), defaultdict(dict), {}
    for p, i, kind in edges:
        size[p] += 1
        if kind:
            scores[i][kind] = 1.0
    for turn in range(rounds):
        sums = defaultdict(lambda: defaultdict(lambda: [0.0, 0]))
        for p, i, _ in edges:
            for kind, x in scores[i].items():
                sums[p][kind][0] += x
                sums[p][kind][1] += x == 1.0
        patterns = {p: {k: (x / (size[p] + 1), n) for k, (x, n) in kinds.items()} for p, kinds in sums.items()}
        learned = defaultdict(lambda: defaultdict(list))
        for p, i, kind in edges:
            if kind is None:
                for k, (x, n) in patterns.get(p, {}).items():
                    if n >= least_seeds:
                        learned[i][k].append(x)
        for i, kinds in learned.items():
            scores[i] = {k: 1 - math.prod(max(1 - x, 1e-6) for x in xs) for k, xs in kinds.items()}
    return patterns


def test_scores_against_plain_python(spark):
    rng = random.Random(3)
    kinds = {f"i{k}": rng.choice(["email", "ip", None, None]) for k in range(60)}
    edges = sorted({(f"p{rng.randrange(12)}", i) for i in kinds for _ in range(rng.randint(1, 5))})
    edges = [(p, i, kinds[i]) for p, i in edges]
    table = spark.createDataFrame([(*e, 1) for e in edges], "pattern string, instance string, kind string, n long")
    for rounds, least in ((1, 2), (2, 2), (3, 3)):
        want = plain_scores(edges, rounds, least)
        got = {r.pattern: r for r in pii.score_patterns(table, rounds=rounds, least_seeds=least).collect()}
        assert set(got) == set(want)
        for p, kinds_of in want.items():
            score, seeds, kind = max((round(x, 9), n, k) for k, (x, n) in kinds_of.items())
            assert abs(got[p].score - score) < 1e-6 and got[p].n_seeds == seeds and got[p].kind == kind


KEY = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"


def test_secrets_shapes_and_contexts(spark):
    texts = [f'note {i} token = "{KEY[i:] + KEY[:i]}" end' for i in range(8)]
    texts += [f"ticket {n} paid with {n}" for n in ("4111111111111111", "5500005555555559", "340000000000000900", "6011000000000004", "4012888888881881", "3530111333300000")]
    texts += ['note 9 token = "Zz9-short.key" end', "paid 4111111111111112 by mistake", "plain words and 12345 numbers", None, ""]
    texts += ["x" * 500 + "1" * 90 + " " + "y" * 400 + ' token = "q9.q9.q9" end']
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "spans").collect()
    spans = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in rows}
    assert all(spans[i] == [("secret", KEY[i:] + KEY[:i])] for i in range(8))
    assert spans[14] == [("context_secret", "Zz9-short.key")]
    assert spans[19][-1] == ("context_secret", "q9.q9.q9")  # far behind long words
    assert spans[16] == spans[17] == spans[18] == []


def test_planted_on_prose(spark):
    """Recall and precision on planted rows: phrases that seeds teach, among prose with numbers of its own."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts, planted = [], {}
    for i in range(60):
        texts.append(f"{prose(10)} write to member u{i}@mail.example.org {prose(10)}")
    for i in range(30):
        token = f"{rng.choice('ABC')}{rng.randrange(10**4, 10**6)}-{word()}"
        planted[len(texts)] = token
        texts.append(f"{prose(10)} write to member {token} {prose(10)}")
    for i in range(200):
        texts.append(f"{prose(10)} {word()}{rng.randrange(10**4, 10**7)} {prose(10)}")
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "spans").collect()
    found = {(r.doc_id, texts[r.doc_id][s.start : s.end]) for r in rows for s in r.spans if s.kind.startswith("context_")}
    hits = found & set(planted.items())
    assert len(hits) >= 0.95 * len(planted) and len(hits) >= 0.95 * len(found)


def test_base_spans_are_untouched(spark):
    texts = [f'm{i}@x.org {KEY} 10.0.0.{i} 4111 1111 1111 1111 +1 (555) 123-45{i:02}, {KEY}' for i in range(6)]
    got = pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    rows = got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(brute.pii(list(enumerate(texts))))
    assert all(r.n_added == 2 and r.n_spans == r.n_added + r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.drop("spans").collect())
